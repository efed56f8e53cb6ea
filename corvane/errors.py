"""Errors by status code."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors; ``code`` names the status."""

    code = "UNKNOWN"


class InvalidArgument(EngineError, ValueError):
    code = "INVALID_ARGUMENT"


class NotFound(EngineError, KeyError):
    code = "NOT_FOUND"


class AlreadyExists(EngineError):
    code = "ALREADY_EXISTS"


class FailedPrecondition(EngineError):
    code = "FAILED_PRECONDITION"


class NotSupported(EngineError):
    code = "NOT_SUPPORTED"


class PermissionDenied(EngineError):
    code = "PERMISSION_DENIED"
