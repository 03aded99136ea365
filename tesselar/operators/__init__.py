"""Checks, slices and re-sharding."""
