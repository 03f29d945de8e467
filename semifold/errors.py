"""Errors raised while a request is parsed or compiled."""


class QueryError(ValueError):
    """The request body is malformed."""


class UnsupportedTypeError(QueryError):
    """A join key has a type that filter joins do not accept."""


class TermsLimitExceeded(RuntimeError):
    """A key set is larger than the guard that the caller asked for."""
