"""Errors with the SQLSTATE-like code that a client sees."""

from __future__ import annotations


class EngineError(Exception):
    """``code`` is the five-character wire code: 42601 syntax, 22000 bad input, 42804 types, 23505 duplicate key ..."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
