"""Errors of the table engine."""

from __future__ import annotations


class TableError(Exception):
    """Base of all errors of this library."""


class TableNotFound(TableError):
    """There is no table at the path."""


class InvalidLog(TableError):
    """The log has a gap, lacks protocol or metadata, or contradicts itself."""


class VersionNotFound(TableError):
    """The version is not in the log."""


class UnsupportedFeature(TableError):
    """The table needs a feature that the operation does not support."""


class SchemaError(TableError):
    """A schema is invalid, or a read or write does not fit it."""


class PredicateError(TableError):
    """A predicate cannot be parsed or names an unknown column."""


class TimestampOutOfRange(TableError):
    """No version fits the timestamp."""


class EmptyTimestampRange(TimestampOutOfRange):
    """The interval lies between two commits."""


class CommitConflict(TableError):
    """Another writer has committed this version."""

    def __init__(self, version: int):
        super().__init__(f"version {version} exists already")
        self.version = version


class RetryableCommit(TableError):
    """Storage failed while committing; the same transaction may be tried again."""


class TransactionError(TableError):
    """The content of a transaction is not allowed."""


class ChangeFeedError(TableError):
    """The change feed is not available for the whole range."""


class DeletionVectorError(TableError):
    """A deletion vector is damaged or of an unknown form."""
