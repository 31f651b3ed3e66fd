"""Filter dictionaries as conditions on path-qualified columns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.coerce import coerce
from ..functions.predicates import fold_all, fold_any, registry
from ..settings import settings
from ..sources.catalog import Catalog, Entity


@dataclass(frozen=True)
class Condition:
    """A condition and the relation paths whose columns it needs."""

    test: Column
    paths: frozenset[tuple[str, ...]]


class Resolver(Protocol):
    def resolve(self, entity: Entity, path: str) -> tuple[tuple[str, ...], DataType, str]: ...


class CatalogResolver:
    """Dotted paths along the catalog's relations."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def resolve(self, entity: Entity, path: str) -> tuple[tuple[str, ...], DataType, str]:
        steps, target, name = self.catalog.resolve(entity, path)
        return steps, self.catalog.type_of(target, name), name


def qualified(steps: tuple[str, ...], name: str) -> Column:
    return F.col(f"`{'.'.join(steps) or '$'}.{name}`")


class FilterBuilder:
    """Compiles a filter: fields and their operators are joined by AND; ``and`` and ``or`` hold lists of filters.

    A list's filters are taken apart before they are joined, so that an ``or`` joins all the conditions in it, also
    those of one field or one dictionary. A list that leaves no condition has no effect."""

    def __init__(self, catalog: Catalog, entity: Entity | str, resolver: Resolver | None = None):
        self.entity, self.resolver = catalog.entity(entity), resolver or CatalogResolver(catalog)

    def build(self, filters: dict[str, Any] | None) -> list[Condition]:
        found: list[Condition] = []
        for name, value in (filters or {}).items():
            if name in ("and", "or"):
                inner = [c for part in value for c in self.build(part)]
                test = (fold_all if name == "and" else fold_any)(c.test for c in inner)
                if test is not None:
                    found.append(Condition(test, frozenset().union(*(c.paths for c in inner))))
                continue
            steps, kind, field = self.resolver.resolve(self.entity, name)
            column, paths = qualified(steps, field), frozenset([steps] if steps else [])
            for operator, operand in value.items() if isinstance(value, dict) and set(value) != {"$date"} else [("eq", value)]:
                if operator not in settings.FILTER_OPERATORS or operator not in registry:
                    raise ValueError(f"Unsupported operator: {operator}")
                test = registry[operator](column, kind, coerce(kind, operator, operand))
                if test is not None:
                    found.append(Condition(test, paths))
        return found
