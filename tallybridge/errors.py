"""Errors raised while a job is being described, before any data is read."""


class SpecError(ValueError):
    """A source specification is incomplete or contradicts itself."""


class SchemaError(ValueError):
    """The two relations cannot be matched on the requested keys."""
