"""One exception tree for all parts."""

from __future__ import annotations


class DocframeError(Exception):
    """Base of all errors."""


class QueryError(DocframeError):
    """A query can't be built."""


class StorageError(DocframeError):
    """The store can't do what was asked."""


class ClosedError(StorageError):
    """The store was closed."""


class LogError(StorageError):
    """An entry of the write-ahead log is damaged."""


class ManifestError(StorageError):
    """A table is registered twice or isn't registered, or its files are missing."""


class CommitConflict(StorageError):
    """Another writer has made the same commit."""


class SchemaError(DocframeError):
    """A schema can't be built."""


class TransactionError(DocframeError):
    """A transaction can't go on."""


class AlreadyFinalised(TransactionError):
    """The transaction was committed or rolled back before."""

    def __init__(self) -> None:
        super().__init__("this transaction has ended: it was committed or rolled back")


class Conflict(TransactionError):
    """A document that the transaction has read was changed by another writer."""

    def __init__(self, doc_id: int, read_version: int, current_version: int) -> None:
        super().__init__(f"document {doc_id} was read at version {read_version} but is at {current_version} now")
        self.doc_id, self.read_version, self.current_version = doc_id, read_version, current_version
