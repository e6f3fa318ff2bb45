"""What can be wrong with a request."""

from __future__ import annotations


class PivotError(ValueError):
    """A request that cannot be run."""


class FieldNotFoundError(PivotError):
    def __init__(self, field: str) -> None:
        super().__init__(f"no field named {field!r}")
        self.field = field


class FieldTypeError(PivotError):
    def __init__(self, field: str | None, aggregation: str | None, message: str) -> None:
        super().__init__(message)
        self.field, self.aggregation = field, aggregation


class SessionExpiredError(PivotError):
    """A page of a session that is no longer held."""
