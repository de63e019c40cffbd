"""Errors raised on the driver; inside a plan the same texts come through ``raise_error``."""


class ConversionError(Exception):
    """Any failure to describe, check, convert, store or read a table."""


class SchemaError(ConversionError):
    @classmethod
    def mismatch(cls, expected, actual):
        return cls(f"Type mismatch: expected {expected}, got {actual}")

    @classmethod
    def missing(cls, field):
        return cls(f"Missing required field: {field}")

    @classmethod
    def unsupported(cls, what):
        return cls(f"Unsupported type: {what}")


class LogicalError(ConversionError):
    @classmethod
    def invalid(cls, field, reason):
        return cls(f"Invalid value for field '{field}': {reason}")

    @classmethod
    def structure(cls, what):
        return cls(f"Structure mismatch: {what}")


class StripedError(ConversionError):
    @classmethod
    def columns(cls, expected, actual):
        return cls(f"Column count mismatch: expected {expected}, got {actual}")

    @classmethod
    def vector(cls, what):
        return cls(f"Vector operation failed: {what}")


class BinaryError(ConversionError):
    pass
