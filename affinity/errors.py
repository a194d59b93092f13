"""Errors of the engine."""


class AffinityError(Exception):
    """Base of all domain errors."""


class ParseError(AffinityError):
    """An input that cannot be read as an export at all."""


class StorageError(AffinityError):
    """No folder that driver and executors share."""
