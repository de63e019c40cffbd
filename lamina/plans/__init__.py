"""Conversions and reports made of several operators, and their command line."""
