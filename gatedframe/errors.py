"""Failures that a caller is told about."""

from __future__ import annotations


class QueryError(Exception):
    def __init__(self, code: str, message: str, detail: dict | None = None):
        super().__init__(message)
        self.code, self.message, self.detail = code, message, detail or {}
