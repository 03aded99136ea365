"""Topologies, layouts and copy plans."""
