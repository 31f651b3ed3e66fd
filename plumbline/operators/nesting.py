"""Flat joined rows as nested objects: on the driver for pages, as a DataFrame for results of any size.

An object is known by its key within its parent. Lists of children hold each value once, in the order of their
first rows; a child whose selected fields are all null is none (a left join's miss); a root like that is
left out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .selection import Node

#: Bytes of the tables, as they are stored, and rows for each task that puts objects together; the most such tasks. From UNKNOWN on, a size is Spark's stand-in for none.
TASK_BYTES, TASK_ROWS, MOST_TASKS, UNKNOWN = 2 << 20, 100_000, 1 << 15, 1 << 60


class Record(dict):
    """A result object; fields can be read as attributes too."""

    def __getattr__(self, name: str) -> Any:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None


def _same(value: Any) -> Any:
    """A hashable stand-in, equal for what Spark takes for equal: not-a-number is itself, lists and records are their contents."""
    if isinstance(value, dict):
        return tuple((k, _same(v)) for k, v in value.items())
    if isinstance(value, list | tuple):
        return tuple(map(_same, value))
    if isinstance(value, bytearray):
        return bytes(value)
    return "not a number" if isinstance(value, float) and value != value else value


def nest(rows: Iterable[Any], root: Node) -> list[Record]:
    """rows: with a column for each selected field and each key, by qualified name."""
    rows = list(rows)
    if not rows:
        return []
    place = {name: k for k, name in enumerate(rows[0].__fields__)}
    top: dict[tuple, tuple[Record, dict]] = {}

    def add(node: Node, row: Any, found: dict[tuple, tuple[Record, dict]]) -> None:
        values = [row[place[node.column(f)]] for f in node.fields]
        if node.fields and all(v is None for v in values):
            return
        key = tuple(row[place[node.column(k)]] for k in node.entity.pk)
        if key not in found:
            found[key] = Record(zip(node.fields, values, strict=True)), {name: {} for name in node.children}
        for name, child in node.children.items():
            add(child, row, found[key][1][name])

    def finish(node: Node, found: dict[tuple, tuple[Record, dict]]) -> list[Record]:
        out = []
        for record, inner in found.values():
            for name, child in node.children.items():
                objects = finish(child, inner[name])
                distinct = list({_same(x): x for x in reversed(objects)}.values())[::-1]
                record[name] = distinct if child.relation.many else distinct[0] if distinct else None
            out.append(record)
        return out

    for row in rows:
        add(root, row, top)
    return finish(root, top)


def plain(value: Any) -> Any:
    """Records as dictionaries."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(x) for x in value] if isinstance(value, list) else value


def tasks_of(flat: DataFrame) -> int | None:
    """Tasks that grow with what the tables of the flat rows hold, whatever the number of shuffle partitions; None if a table's size isn't known. Nothing runs."""
    plan, spark = flat._jdf.queryExecution().optimizedPlan(), flat.sparkSession
    leaves = plan.collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    if any(size >= UNKNOWN for size in sizes):
        return None
    tasks = max(-(-sum(sizes) // TASK_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    most = plan.maxRows()
    return max(1, min(tasks, MOST_TASKS, -(-most.get() // TASK_ROWS) if most.isDefined() else MOST_TASKS))


def _carried(parent: Node, name: str) -> bool:
    """Whether the relation is the same in all rows of one parent, by keys that are unique: then its object is a field of the parent's."""
    child = parent.children[name]
    known = parent.entity.unique and child.entity.unique and not child.relation.many and bool(child.entity.pk) and {*child.entity.pk} <= {b for _, b in child.relation.on}
    return known and name not in parent.fields and all(_carried(child, x) for x in child.children)


def _gathered(node: Node) -> Iterator[Node]:
    """The node and all below whose objects have rows of their own, parents first."""
    yield node
    for name, child in node.children.items():
        if not _carried(node, name):
            yield from _gathered(child)


def nested_frame(flat: DataFrame, root: Node) -> DataFrame:
    """The same as a DataFrame: a column for each selected field and relation, rows in the order of the flat ones.

    The flat rows are read once and dealt once, by the root's key, to tasks that follow the size of the tables. Each stands for an
    object of every node that isn't carried by its parent: rows of objects are made distinct, then, from the deepest nodes up, gathered
    in their parents; the dealing holds for all of these groups. Rows are made distinct by one sort, which a pair of aggregates would hold twice."""
    nodes = list(_gathered(root))
    keys = [[f"_k{m}_{i}" for i in range(len(node.entity.pk))] for m, node in enumerate(nodes)]
    number = {node.steps: m for m, node in enumerate(nodes)}
    below = [[k for k, other in enumerate(nodes) if other.steps[: len(node.steps)] == node.steps] for node in nodes]
    every = [k for own in keys for k in own]

    def is_one(node: Node) -> Column:
        test = F.lit(not node.fields)
        for f in node.fields:
            test = test | F.col(f"`{node.column(f)}`").isNotNull()
        return test

    def own(node: Node) -> Column:
        """The node's fields and the objects it carries, if it and all above it are objects."""
        test = is_one(root)
        for k in range(1, len(node.steps) + 1):
            test = test & is_one(root.at(node.steps[:k]))
        parts = [*(F.col(f"`{node.column(f)}`").alias(f) for f in node.fields), *(own(child).alias(name) for name, child in node.children.items() if _carried(node, name))]
        return F.when(test, F.struct(*(parts or [F.lit(None).cast("void").alias("_none")])))

    named = [F.col(f"`{node.column(k)}`").alias(name) for node, names in zip(nodes, keys, strict=True) for k, name in zip(node.entity.pk, names, strict=True)]
    rows = flat.withColumn("_at", F.monotonically_increasing_id()).select("_at", *named, *(own(node).alias(f"_v{m}") for m, node in enumerate(nodes)))
    tasks = tasks_of(flat)
    dealt = (rows.repartition(tasks, *keys[0]) if tasks else rows.repartition(*keys[0])).withColumn("_n", F.explode(F.array(*map(F.lit, range(len(nodes))))))
    n = F.col("_n")

    def first(df: DataFrame, *by: str, at: Column) -> DataFrame:
        """The first row of each group."""
        return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(at))).where(F.col("_rank") == 1).drop("_rank")

    # The keys of the nodes on the way to that of the row; others are null.
    masked = [F.when(n.isin(below[m]), F.col(k)).alias(k) if m else F.col(k) for m, names in enumerate(keys) for k in names]
    values = [f"_v{m}" for m in range(len(nodes))]
    found = dealt.select("_n", "_at", *masked, *(F.when(n == m, F.col(v)).alias(v) for m, v in enumerate(values))).where(reduce(or_, (F.col(v).isNotNull() for v in values)))
    found = first(found, "_n", *every, at=F.col("_at"))  # of the rows of one key, the first's fields

    def built(m: int) -> list[Column]:
        """The fields and children of a row's object."""
        node = nodes[m]
        parts = [F.col(f"_v{m}")[f].alias(f) for f in node.fields]
        for name, child in node.children.items():
            if _carried(node, name):
                parts.append(F.col(f"_v{m}")[name].alias(name))
                continue
            listed = F.transform(F.array_sort(f"_l{number[child.steps]}"), lambda x: x["o"])
            parts.append((listed if child.relation.many else F.get(listed, 0)).alias(name))
        return parts

    for depth in range(max(len(node.steps) for node in nodes), 0, -1):
        here = [m for m, node in enumerate(nodes) if len(node.steps) == depth]
        above = [m for m, node in enumerate(nodes) if len(node.steps) < depth]
        parent = n
        for m in here:
            parent = F.when(n == m, number[nodes[m].steps[:-1]]).otherwise(parent)
        moved = n.isin(here)
        # An object becomes a child of its parent's key; the others stay.
        objects = [F.when(n == m, F.struct(*built(m)) if built(m) else F.struct(F.lit(None).cast("void").alias("_none"))).alias(f"_o{m}") for m in here]
        kept = [k for m in above for k in keys[m]]
        step = found.select(parent.alias("_n"), *kept, F.when(~moved, F.col("_at")).alias("_at"), F.when(moved, F.col("_at")).alias("_child"), *(f"_v{m}" for m in above), *objects)
        step = first(step, "_n", *kept, *(f"_o{m}" for m in here), at=F.col("_child"))
        gathered = [F.collect_list(F.when(F.col(f"_o{m}").isNotNull(), F.struct("_child", F.col(f"_o{m}").alias("o")))).alias(f"_l{m}") for m in here]
        found = step.groupBy("_n", *kept).agg(F.min("_at").alias("_at"), *(F.min_by(f"_v{m}", "_at").alias(f"_v{m}") for m in above), *gathered)
    found = found.repartitionByRange(tasks, "_at") if tasks else found  # the order's own exchange
    return found.orderBy("_at").select(*(built(0) or [F.lit(None).cast("void").alias("_none")]))
