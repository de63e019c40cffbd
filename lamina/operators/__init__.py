"""Operators over typed tables: validation, merging, defaults, striping."""
