"""One DataFrame plan for a query: joins along the selected relations, conditions, order, page.

Every column is named by its path, ``$.name`` at the root and ``relation.name`` below, so nothing clashes. Filters on the
root reach the scan, unselected columns are pruned, and join strategies are Catalyst's."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FieldNotFound
from ..operators.filters import Condition, FilterBuilder, Resolver
from ..operators.selection import Node, tree
from ..operators.sorting import SortKey, sort_keys
from ..settings import JOIN_TYPES, settings
from ..sources.catalog import Catalog, Entity

Steps = tuple[str, ...]


def join_kind(join_type: str | None) -> str:
    """inner or left; outer means left."""
    name = join_type if join_type is not None else settings.DEFAULT_JOIN_TYPE
    if name not in JOIN_TYPES:
        raise ValueError(f"Invalid join_type: {name}. Supported: {list(JOIN_TYPES)}")
    return "inner" if name == "inner" else "left"


class Planner:
    """Plans the queries of one entity."""

    def __init__(self, catalog: Catalog, entity: str | Entity, *, select: list[Any] | None = None, filter: dict[str, Any] | None = None, sort: list[Any] | None = None, join_type: str | None = None, resolver: Resolver | None = None):
        self.catalog, self.entity = catalog, catalog.entity(entity)
        self.kind = join_kind(join_type)
        self.root = tree(catalog, self.entity, select)
        self.conditions = FilterBuilder(catalog, self.entity, resolver).build(filter)
        self.sort = sort_keys(catalog, self.entity, sort)

    def qualified(self, entity: Entity, path: str) -> DataFrame:
        df = self.catalog.frame(entity)
        return df.select(*(F.col(f"`{c}`").alias(f"{path}.{c}") for c in df.columns))

    def joined(self, df: DataFrame, steps: Steps, kind: str) -> DataFrame:
        """df with the columns of the relation at the end of steps, whose parent df has."""
        parent = self.entity
        for step in steps[:-1]:
            _, parent = self.catalog.related(parent, step)
        link, target = self.catalog.related(parent, steps[-1])
        above, path = ".".join(steps[:-1]) or "$", ".".join(steps)
        on = [F.col(f"`{above}.{a}`") == F.col(f"`{path}.{b}`") for a, b in link.on]
        return df.join(self.qualified(target, path), on, kind)

    def along(self, paths: Iterable[Steps]) -> DataFrame:
        """The root inner-joined along all paths, shorter ones first."""
        df = self.qualified(self.entity, "$")
        for steps in sorted({p[:k] for p in paths for k in range(1, len(p) + 1)}, key=lambda p: (len(p), p)):
            df = self.joined(df, steps, "inner")
        return df

    def _to_one(self, steps: Steps) -> bool:
        own = self.entity
        for step in steps:
            link, own = self.catalog.related(own, step)
            if link.many:
                return False
        return True

    def flat(self) -> DataFrame:
        """All joined rows that meet the conditions, with all columns of the entities selected from."""
        df, there = self.qualified(self.entity, "$"), {()}
        for node in self.root.walk():
            if node.steps:
                df = self.joined(df, node.steps, self.kind)
                there.add(node.steps)
        for key in self.sort:
            for k in range(1, len(key.steps) + 1):
                steps = key.steps[:k]
                if steps not in there:
                    if not self._to_one(steps):
                        raise FieldNotFound(f"To sort by {'.'.join(key.steps)}, select from it")
                    df = self.joined(df, steps, "left")
                    there.add(steps)
        near = [c for c in self.conditions if c.paths <= there]
        far = [c for c in self.conditions if not c.paths <= there]
        for c in near:
            df = df.where(c.test)
        return self._existing(df, far, there) if far else df

    def entity_at(self, steps: Steps) -> Entity:
        own = self.entity
        for step in steps:
            _, own = self.catalog.related(own, step)
        return own

    def _existing(self, df: DataFrame, far: list[Condition], there: set[Steps]) -> DataFrame:
        """Rows for which the relations that are not selected have a row that meets all of the conditions.

        Below each relation that leaves what is there, one semi-join; conditions that need several of them at once are
        tested on rows of the root joined with all of these."""
        groups: list[tuple[set[Steps], list[Condition]]] = []
        for c in far:
            tops = {next(p[:k] for k in range(1, len(p) + 1) if p[:k] not in there) for p in c.paths - there}
            met = [g for g in groups if g[0] & tops]
            groups = [g for g in groups if not g[0] & tops] + [(tops.union(*(g[0] for g in met)), [*(x for g in met for x in g[1]), c])]
        for tops, conditions in groups:
            df = self._below(df, *tops, conditions) if len(tops) == 1 else self._several(df, conditions, there)
        return df

    def _below(self, df: DataFrame, top: Steps, conditions: list[Condition]) -> DataFrame:
        """df semi-joined with the relation at top, of whose parent df has the columns, and those below it."""
        link, target = self.catalog.related(self.entity_at(top[:-1]), top[-1])
        other, above, path = self.qualified(target, ".".join(top)), ".".join(top[:-1]) or "$", ".".join(top)
        for steps in sorted({p[:k] for c in conditions for p in c.paths for k in range(len(top) + 1, len(p) + 1) if p[: len(top)] == top}, key=lambda p: (len(p), p)):
            other = self.joined(other, steps, "inner")
        on = [F.col(f"`{above}.{a}`") == F.col(f"`{path}.{b}`") for a, b in link.on]
        return df.join(other, [*on, *(c.test for c in conditions)], "left_semi")

    def _several(self, df: DataFrame, far: list[Condition], there: set[Steps]) -> DataFrame:
        paths = {p for c in far for p in c.paths if p not in there}
        other = self.along(paths)
        steps = {p[:k] for p in paths for k in range(1, len(p) + 1)}
        shared = {f"{'.'.join(s) or '$'}." for s in there if s in steps or s == ()}
        mine = [c for c in other.columns if not any(c.startswith(p) and "." not in c[len(p) :] for p in shared)]
        # The same root and, along a path that is partly selected, the same selected objects.
        own = [s for s in there if not s or s in steps]
        keys = [(name, f"_key.{name}") for s in own for name in (f"{'.'.join(s) or '$'}.{k}" for k in self.entity_at(s).pk)]
        other = other.select(*(F.col(f"`{a}`").alias(b) for a, b in keys), *(F.col(f"`{c}`") for c in mine))
        on = [F.col(f"`{a}`") == F.col(f"`{b}`") for a, b in keys]
        return df.join(other, [*on, *(c.test for c in far)], "left_semi")

    def order(self) -> list[Column]:
        """The sort keys, then the keys of the entities selected from, so that pages are stable."""
        ties = [F.col(f"`{node.column(k)}`").asc_nulls_first() for node in self.root.walk() for k in node.entity.pk]
        return [*(k.order for k in self.sort), *ties]

    def page(self, limit: int | None, offset: int | None) -> DataFrame:
        """The flat rows in order, from offset on, limit at most: rows of the join, not objects."""
        df = self.flat().orderBy(*self.order())
        df = df.offset(offset) if offset else df
        df = df.limit(limit) if limit else df
        return self.needed(df)

    def needed(self, df: DataFrame, *more: str) -> DataFrame:
        """The selected fields and the keys, by qualified name."""
        names = [node.column(c) for node in self.root.walk() for c in [*node.fields, *(k for k in node.entity.pk if k not in node.fields)]]
        return df.select(*(F.col(f"`{c}`") for c in dict.fromkeys(names)), *more)

    def selected(self) -> list[tuple[str, str]]:
        """(qualified name, name in flat results) of the selected fields in their order."""
        return [(node.column(f), f if not node.steps else f"{node.path}.{f}") for node in self.root.walk() for f in node.fields]

    def matching(self, *more: Steps) -> DataFrame:
        """Root rows joined along further paths, that meet the conditions; joins of the selection have no part in it."""
        df = self.along(s for s in more if s)
        there = {(), *(s[:k] for s in more for k in range(1, len(s) + 1))}
        for c in self.conditions:
            df = df.where(c.test) if c.paths <= there else df
        far = [c for c in self.conditions if not c.paths <= there]
        return self._existing(df, far, there) if far else df

    def distinct_roots(self, *more: Steps) -> Column:
        """Counts the roots among rows of matching()."""
        if self.entity.unique and all(self._to_one(s) for s in more if s):
            return F.count(F.lit(1))
        return F.count_distinct(*(F.col(f"`$.{k}`") for k in self.entity.pk))
