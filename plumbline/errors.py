"""Errors of the query layer."""


class FieldNotFound(AttributeError):
    """A name in a query is no field or relation of its entity."""
