"""Errors that callers can tell apart."""

from __future__ import annotations


class StoreError(Exception):
    """Any error of the store."""


class KeyTypeError(StoreError, TypeError):
    """A key is neither of the index's type nor convertible to it."""


class UniqueViolation(StoreError):
    """Two documents have one key of a unique index."""

    def __init__(self, index: str, key: object) -> None:
        super().__init__(f"index {index!r} is unique, but more than one document has the key {key!r}")
        self.index, self.key = index, key


class UnknownIndex(StoreError, KeyError):
    """No index of that name is registered."""


class UnknownEndpoint(StoreError):
    """An edge names a node that its graph doesn't hold."""


class NotEmpty(StoreError):
    """An initial load found documents in the collection."""


class TransactionModeError(StoreError):
    """A write inside an active read boundary."""

    def __init__(self, database: object, active_mode: str, requested_mode: str) -> None:
        super().__init__(f"a {requested_mode} isn't possible inside a {active_mode} boundary")
        self.database, self.active_mode, self.requested_mode = database, active_mode, requested_mode


class TransactionDatabaseError(StoreError):
    """Access to one database inside a boundary on another."""

    def __init__(self, active_database: object, requested_database: object) -> None:
        super().__init__("another database has the active transaction")
        self.active_database, self.requested_database = active_database, requested_database


class CommitConflict(StoreError):
    """Another writer committed first."""


class ViewError(StoreError):
    """A view's mapper failed; holds the view and the cause."""

    def __init__(self, view: object, cause: BaseException) -> None:
        super().__init__(f"view {getattr(view, 'name', view)!r}: {cause}")
        self.view, self.cause = view, cause


class ViewReducerMissing(StoreError):
    """A view without reducer was reduced."""

    def __init__(self, view: object) -> None:
        super().__init__(f"view {getattr(view, 'name', view)!r} has no reducer")
        self.view = view
