"""QueryBuilder: a query put together step by step, and what can be done with it."""

from __future__ import annotations

import asyncio
import logging
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType
from pyspark.sql.window import Window

from .operators.filters import Resolver
from .operators.grouping import GroupByConfig
from .operators.nesting import Record, nest, nested_frame, plain
from .plans.planner import Planner, join_kind
from .settings import settings
from .sources.catalog import Catalog, Entity

logger = logging.getLogger("plumbline")


def _literal(df: DataFrame, key: Column, value: Any) -> Column:
    """A collected key as a literal; times without a zone stay so."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz") if isinstance(value, datetime) and isinstance(df.select(key).schema[0].dataType, TimestampNTZType) else F.lit(value)


class QueryBuilder:
    """Queries of one entity of a catalog."""

    def __init__(self, catalog: Catalog, entity: str | Entity, resolver: Resolver | None = None):
        self.catalog, self.entity, self.resolver = catalog, catalog.entity(entity), resolver
        self.select: list[Any] | None = None
        self.filter: dict[str, Any] | None = None
        self.sort: list[Any] | None = None
        self.limit: int | None = None
        self.offset: int | None = None
        self.join_type: str | None = None

    # -- putting together

    def apply_select(self, select: list[Any] | None = None, join_type: str | None = None) -> QueryBuilder:
        self.select, self.join_type = select, join_type
        join_kind(join_type)
        self.plan()
        return self

    def apply_filter(self, filter: dict[str, Any] | None = None) -> QueryBuilder:
        self.filter = filter
        self.plan()
        return self

    def apply_sort(self, sort: list[Any] | None = None) -> QueryBuilder:
        self.sort = sort
        self.plan()
        return self

    def _number(self, value: int | None, default: int, what: str) -> int | None:
        """None and 0 set nothing; a negative number gives way to the default."""
        if value is not None and value < 0:
            logger.warning("%s %s is negative; %s is used", what, value, default)
            return default
        return value or None

    def apply_limit(self, limit: int | None = None) -> QueryBuilder:
        self.limit = self._number(limit, settings.DEFAULT_LIMIT, "limit")
        return self

    def apply_offset(self, offset: int | None = None) -> QueryBuilder:
        self.offset = self._number(offset, settings.DEFAULT_OFFSET, "offset")
        return self

    def build(self, select: list[Any] | None = None, filter: dict[str, Any] | None = None, sort: list[Any] | None = None, limit: int | None = None, offset: int | None = None, join_type: str | None = None) -> QueryBuilder:
        self.select, self.filter, self.sort, self.join_type = select, filter, sort, join_type
        self.plan()
        return self.apply_limit(limit).apply_offset(offset)

    def plan(self) -> Planner:
        """Checks all names and values; nothing runs."""
        return Planner(self.catalog, self.entity, select=self.select, filter=self.filter, sort=self.sort, join_type=self.join_type, resolver=self.resolver)

    # -- DataFrames

    def flat_df(self, separator: str = ".") -> DataFrame:
        """A row for each joined row of the page, in order: the root's fields by name, others by path and name."""
        plan = self.plan()
        df = plan.page(self.limit, self.offset)
        return df.select(*(F.col(f"`{a}`").alias(b.replace(".", separator)) for a, b in plan.selected()))

    def exec_df(self, separator: str = ".") -> DataFrame:
        """The distinct flat rows of the page, in the order of their first ones."""
        flat = self.flat_df(separator)
        if len(set(flat.columns)) < len(flat.columns):
            raise ValueError("the columns need distinct names")
        return flat.withColumn("_at", F.monotonically_increasing_id()).groupBy(*(F.col(f"`{c}`") for c in flat.columns)).agg(F.min("_at").alias("_at")).orderBy("_at").drop("_at")

    def nested_df(self) -> DataFrame:
        """A row for each object of the page, relations as structs and arrays of structs."""
        plan = self.plan()
        return nested_frame(plan.page(self.limit, self.offset), plan.root)

    def count_df(self) -> DataFrame:
        plan = self.plan()
        return plan.matching().agg(plan.distinct_roots().cast("long").alias("total"))

    # -- results

    def fetch(self) -> list[Record]:
        """The objects of the page. Without a limit, that is the whole result."""
        plan = self.plan()
        return nest(plan.page(self.limit, self.offset).collect(), plan.root)

    def exec(self) -> list[tuple]:
        """The distinct flat rows of the page, in order."""
        return list(dict.fromkeys(tuple(r) for r in self.flat_df().collect()))

    def count(self) -> int:
        """Roots that meet the filter; order, page and joins of the selection don't matter."""
        return self.count_df().first()[0]

    def serialize(self, objects: list[Record]) -> list[dict[str, Any]]:
        return plain(objects)

    # -- groups

    def _keyed(self, config: GroupByConfig) -> tuple[Planner, Column, tuple[str, ...]]:
        plan = self.plan()
        return plan, *config.key(self.catalog, self.entity)

    def group_keys_df(self, config: GroupByConfig) -> DataFrame:
        """key and total (roots), by key, null first."""
        plan, key, steps = self._keyed(config)
        return plan.matching(steps).groupBy(key.alias("key")).agg(plan.distinct_roots(steps).cast("long").alias("total")).orderBy(F.col("key").asc_nulls_first())

    def get_distinct_group_keys(self, config: GroupByConfig) -> list[tuple[Any, int]]:
        return [tuple(r) for r in self.group_keys_df(config).collect()]

    def _flat_with_key(self, config: GroupByConfig) -> tuple[Planner, DataFrame, Column]:
        """The joined rows, with the columns that the key needs."""
        plan, key, steps = self._keyed(config)
        there = {node.steps for node in plan.root.walk()}
        if steps and steps not in there:
            link = self.catalog
            own = self.entity
            for step in steps:
                relation, own = link.related(own, step)
                if relation.many:
                    return plan, self._rows_by_far_key(plan, key, steps), F.col("_key")
            df = plan.flat()
            for k in range(1, len(steps) + 1):
                if steps[:k] not in there:
                    df = plan.joined(df, steps[:k], "inner")
            return plan, df, key
        return plan, plan.flat(), key

    def _rows_by_far_key(self, plan: Planner, key: Column, steps: tuple[str, ...]) -> DataFrame:
        """The rows of each root under each of the keys that its relations have."""
        pk = [F.col(f"`$.{k}`").alias(f"_root{i}") for i, k in enumerate(self.entity.pk)]
        keys = plan.along([steps]).select(*pk, key.alias("_key")).distinct()
        on = [F.col(f"`$.{k}`") == F.col(f"_root{i}") for i, k in enumerate(self.entity.pk)]
        return plan.flat().join(keys, on)

    def items_df(self, config: GroupByConfig, limit: int, offset: int = 0, keys: list[Any] | None = None) -> DataFrame:
        """Joined rows by key: those from offset on in their group's order, limit at most; _key and _rank are added.

        Rows that rank too low are dropped before the shuffle, so a large group is no task's burden."""
        plan, df, key = self._flat_with_key(config)
        if keys is not None:
            known = [_literal(df, key, k) for k in keys if k is not None]
            test = key.isin(*known) if known else F.lit(False)
            df = df.where(test | key.isNull() if None in keys else test)
        window = Window.partitionBy("_key").orderBy(*plan.order())
        ranked = df.withColumn("_key", key).withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= offset + limit)
        return plan.needed(ranked.where(F.col("_rank") > offset) if offset else ranked, "_key", "_rank")

    def grouped_df(self, config: GroupByConfig, limit: int, offset: int = 0, separator: str = ".") -> DataFrame:
        """key, rank and the selected fields of each group's page, without a limit over all groups."""
        plan = self.plan()
        rows = self.items_df(config, limit, offset)
        return rows.select(F.col("_key").alias("key"), F.col("_rank").alias("rank"), *(F.col(f"`{a}`").alias(b.replace(".", separator)) for a, b in plan.selected()))

    def fetch_for_group(self, config: GroupByConfig, key: Any, limit: int | None = None, offset: int | None = None) -> list[Record]:
        rows = self.items_df(config, limit or settings.DEFAULT_LIMIT, offset or 0, [key]).orderBy("_rank").collect()
        return nest(rows, self.plan().root)

    def count_for_group(self, config: GroupByConfig, key: Any) -> int:
        plan, column, steps = self._keyed(config)
        df = plan.matching(steps)
        return df.where(column.eqNullSafe(_literal(df, column, key))).agg(plan.distinct_roots(steps)).first()[0]

    # -- the same, awaited

    async def fetch_async(self) -> list[Record]:
        return await asyncio.to_thread(self.fetch)

    async def exec_async(self) -> list[tuple]:
        return await asyncio.to_thread(self.exec)

    async def count_async(self) -> int:
        return await asyncio.to_thread(self.count)

    async def get_distinct_group_keys_async(self, config: GroupByConfig) -> list[tuple[Any, int]]:
        return await asyncio.to_thread(self.get_distinct_group_keys, config)

    async def fetch_for_group_async(self, config: GroupByConfig, key: Any, limit: int | None = None, offset: int | None = None) -> list[Record]:
        return await asyncio.to_thread(self.fetch_for_group, config, key, limit, offset)

    async def count_for_group_async(self, config: GroupByConfig, key: Any) -> int:
        return await asyncio.to_thread(self.count_for_group, config, key)
