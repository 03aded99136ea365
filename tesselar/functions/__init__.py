"""Boxes and element types as Columns."""
