"""Errors with the dialect's codes and constraint kinds."""

from __future__ import annotations

# The error codes and the constraint kinds.
CODES = ("error", "syntax", "no such table", "no such column", "constraint", "mismatch", "busy", "readonly", "interrupt", "full", "misuse")
CONSTRAINTS = ("not null", "check", "unique", "primary key", "foreign key", "trigger", "strict type")


class EngineError(Exception):
    """An error of the engine: ``code`` is one of CODES, ``constraint`` one of CONSTRAINTS or None."""

    def __init__(self, message: str, code: str = "error", constraint: str | None = None):
        super().__init__(message)
        self.code, self.constraint = code, constraint


def of_spark(error: Exception) -> EngineError:
    """The engine's error for one that Spark raised."""
    text = str(error).split("\n", 1)[0]
    for mark, code, constraint in (
        ("TABLE_OR_VIEW_NOT_FOUND", "no such table", None), ("UNRESOLVED_COLUMN", "no such column", None), ("PARSE_SYNTAX_ERROR", "syntax", None),
        ("UNIQUE constraint", "constraint", "unique"), ("FOREIGN KEY constraint", "constraint", "foreign key"), ("DATATYPE_MISMATCH", "mismatch", None),
    ):
        if mark in str(error):
            return EngineError(text, code, constraint)
    return EngineError(text)
