"""Errors. A message may name code, verbs and columns that the analyst typed, never data."""

from __future__ import annotations


class HushError(Exception):
    """Base class."""


class ValidationError(HushError):
    """The gate refused the script."""

    def __init__(self, message: str, *, kind: str = "validation", line: int | None = None, token: str | None = None):
        super().__init__(message)
        self.message, self.kind, self.line, self.token = message, kind, line, token

    def as_dict(self) -> dict:
        return {"kind": self.kind, "message": self.message, "line": self.line, "token": self.token}


class SandboxError(HushError):
    """The script failed while running; only the class of what it raised is kept."""


class DisclosureError(HushError):
    """A rule of disclosure control refused a result."""
