"""Stable error codes."""

from __future__ import annotations


class EngineError(Exception):
    """A request that cannot be answered; ``code`` is part of the API."""

    def __init__(self, code: str, message: str, **details):
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message
        self.details = details

    def as_dict(self) -> dict:
        return {"code": self.code, "message": self.message, "details": self.details}
