"""What can go wrong."""


class StoreError(Exception):
    """Root of the engine's errors."""


class SparqlError(StoreError):
    """A query that cannot be parsed or is not supported."""


class DataError(StoreError):
    """Terms or documents that are not valid RDF."""
