"""Typed errors raised by the library."""


class LedgerError(ValueError):
    """Base class; ``code`` is the stable machine-readable reason."""

    code = "INTERNAL_ERROR"


class InvalidInput(LedgerError):
    code = "INVALID_INPUT"


class InputNotFound(LedgerError):
    code = "FILE_NOT_FOUND"


class OutputExists(LedgerError):
    code = "OUTPUT_EXISTS"
