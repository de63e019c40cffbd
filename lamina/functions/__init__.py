"""Column expressions: integer codecs."""
