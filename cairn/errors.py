"""What the engine raises; ``status`` is the HTTP status of each."""


class EngineError(Exception):
    status = 500


class BadRequest(EngineError, ValueError):
    status = 400


class NotFound(EngineError):
    status = 404


class Conflict(EngineError):
    status = 409


class StorageError(EngineError, OSError):
    status = 500
