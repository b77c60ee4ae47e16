"""What the engine raises; ``path`` tells where in the arguments."""

from __future__ import annotations


class QueryError(ValueError):
    def __init__(self, message: str, path: tuple = ()):
        self.path = tuple(path)
        super().__init__(message + (f" (at {'.'.join(map(str, self.path))})" if self.path else ""))


class UnsupportedQuery(QueryError):
    """A shape that the engine knows of but does not run."""


class LimitExceeded(QueryError):
    """A limit of ``config.Limits`` is passed."""
