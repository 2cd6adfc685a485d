"""Errors of the engine; every refusal is one of these, there are no silent partial results."""


class EngineError(Exception):
    """Base of all."""


class ValidationError(EngineError):
    """The request or the data is malformed."""


class DimensionMismatch(ValidationError):
    """A vector has other dimensions than its namespace."""


class FieldNotConfigured(ValidationError):
    """A full-text query names a field without an analyzer."""


class NotFound(EngineError):
    """No such namespace, snapshot or row."""


class Conflict(EngineError):
    """Another writer or another configuration came first."""


class PointInTimeNotRetained(EngineError):
    """No retained generation answers the point in time."""


class Denied(EngineError):
    """Policy forbids the request."""


class NotImplementedYet(EngineError):
    """The request asks for something that the engine does not offer."""
