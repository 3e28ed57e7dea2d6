"""Errors of the lookup language, each with the stable code that callers see."""

from __future__ import annotations


class LookupError_(ValueError):
    code = "BQL_EXECUTION_ERROR"


class ParseError(LookupError_):
    code = "BQL_PARSE_ERROR"

    def __init__(self, message: str, code: str | None = None):
        super().__init__(message)
        self.code = code or type(self).code


class TimeFilterError(LookupError_):
    code = "BQL_TIME_FILTER_PARSE_ERROR"


def code_of(error: BaseException) -> str:
    """The code of any exception: its own, or one by kind for those from elsewhere."""
    if own := getattr(error, "code", None):
        return str(own)
    text = str(error).lower()
    if "timestamp" in text or "time filter" in text or "named window" in text:
        return TimeFilterError.code
    if isinstance(error, PermissionError):
        return "BQL_READONLY_SAFETY_ERROR"
    return "BQL_EXECUTION_ERROR" if isinstance(error, ValueError) else "BQL_INTERNAL_ERROR"
