"""Sort lists: ``name``, ``+name``, ``-name``, dotted paths, and orders of given values."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.coerce import coerce
from ..sources.catalog import Catalog, Entity
from .filters import qualified

logger = logging.getLogger("plumbline")


@dataclass(frozen=True)
class SortKey:
    order: Column
    steps: tuple[str, ...]


def _values(item: dict[str, Any]) -> tuple[str, list[Any]] | None:
    """The path and its values in order, if the item is well formed."""
    if len(item) != 1:
        return None
    ((path, values),) = item.items()
    if isinstance(values, dict):
        values = values.get("values", values.get("order"))
    return (path, values) if isinstance(values, list) else None


def sort_keys(catalog: Catalog, entity: Entity, sort: list[Any] | None) -> list[SortKey]:
    """Nulls come first going up and last going down. Of given values, the first comes first; all others and null come after the last."""
    keys = []
    for item in sort or []:
        if isinstance(item, dict):
            if (parsed := _values(item)) is None:
                logger.warning("Sort %r is not understood and left out", item)
                continue
            path, values = parsed
            steps, target, name = catalog.resolve(entity, path)
            column, rank = qualified(steps, name), None
            for k, v in enumerate(values):
                test = column.isNull() if v is None else column == coerce(catalog.type_of(target, name), "eq", v)
                rank = F.when(test, k) if rank is None else rank.when(test, k)
            if rank is not None:
                keys.append(SortKey(rank.otherwise(len(values) + 1).asc(), steps))
        elif isinstance(item, str):
            steps, _, name = catalog.resolve(entity, item[1:] if item[:1] in "+-" else item)
            column = qualified(steps, name)
            keys.append(SortKey(column.desc_nulls_last() if item[0] == "-" else column.asc_nulls_first(), steps))
        else:
            logger.warning("Sort %r is not understood and left out", item)
    return keys
