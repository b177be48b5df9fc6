"""Error categories.  No failed operation looks like an empty result."""


class EngineError(Exception):
    pass


class InvalidArgument(EngineError, ValueError):
    pass


class NotFound(EngineError, LookupError):
    pass


class AlreadyExists(EngineError):
    pass


class Conflict(EngineError):
    """Another writer has committed, or a cursor or handle is stale."""


class Unsupported(EngineError):
    pass


class Unavailable(EngineError):
    """A failed write may have been committed: read it back."""


class PermissionDenied(EngineError):
    pass


class CorruptData(EngineError):
    pass
