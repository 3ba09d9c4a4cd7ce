"""Typed errors. Their kinds are part of the interface."""

from __future__ import annotations

#: Raised from the request and the catalog, before any data is read.
VALIDATION = (
    "MalformedRequest UnknownDataset UnknownTable UnknownFilter UnknownFieldGroup UnknownField InvalidBlockRange InvalidBlockNumber "
    "TooManyItemRequests TooManyBloomValues ConflictingFilters InvalidHex DiscriminatorTooLong InvalidFilterValue UnknownSet InvalidSet "
    "SetCanaryMismatch SetFieldNotSelected RequestTooLarge UnsupportedRequestField"
).split()
#: Raised against a chunk.
EXECUTION = "TableNotFound ColumnNotFound UnexpectedBaseBlock UnsupportedKeyType MalformedChunkData".split()


class QueryError(Exception):
    """A refused request. ``path`` says where in the request; ``blocks`` are a fork's recent (number, hash) pairs."""

    def __init__(self, kind: str, message: str, path: str = "", blocks: list[tuple[int, str]] | None = None):
        assert kind in VALIDATION or kind in EXECUTION, kind
        super().__init__(message)
        self.kind, self.path, self.blocks = kind, path, blocks or []

    @property
    def is_validation(self) -> bool:
        return self.kind in VALIDATION


class CatalogError(ValueError):
    """A catalog that contradicts itself."""
