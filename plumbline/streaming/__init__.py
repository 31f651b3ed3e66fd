"""Queries over streams: selection, filters and to-one relations of a spec, row by row, without state.

Order, pages and groups need all rows, which a stream never has; a spec with them is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.planner import Planner
from ..sources.catalog import Catalog, Entity, dataframe
from ..spec import QuerySpec


def stream(spec: QuerySpec, catalog: Catalog, entity: str | Entity, rows: DataFrame) -> DataFrame:
    """The flat rows of the spec over ``rows``, a stream with the entity's columns; relations are read from the catalog."""
    own = catalog.entity(entity)
    if spec.sort or spec.offset or spec.group_by:
        raise ValueError("a stream has no order, pages or groups")
    live = Catalog(catalog.spark, *catalog.entities.values())
    live.entities[own.name] = Entity(own.name, dataframe(rows), own.pk, own.relations, own.unique)
    plan = Planner(live, own.name, select=spec.select, filter=spec.filter, join_type=spec.join_type)
    if any(node.relation and node.relation.many for node in plan.root.walk()):
        raise ValueError("a stream is joined along to-one relations only")
    return plan.flat().select(*(F.col(f"`{a}`").alias(b) for a, b in plan.selected()))
