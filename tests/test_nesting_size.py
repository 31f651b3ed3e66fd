"""Nested objects of large tables: what a task holds doesn't grow with the tables, and the results stay."""

import os
import re

import pytest

from plumbline import Catalog, Entity, QueryBuilder, Relation, dataframe
from plumbline.operators import nesting
from plumbline.queries import QUERIES
from plumbline.sources.tables import tables

from .test_plans import plan

LARGE = os.environ.get("TEST_LARGE_SF_DIR", "/root/testdata/sf0.1")
needs_tables = pytest.mark.skipif(not os.path.isdir(LARGE), reason="no tables")


def most_of_a_task(spark, run):
    """MB of execution memory of the largest of the tasks that run() makes."""
    sc = spark.sparkContext._jsc.sc()
    store, empty = sc.statusStore(), spark._jvm.java.util.ArrayList()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(empty, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), empty)
        return {(s.stageId(), s.attemptId()) for s in map(found.apply, range(found.size()))}

    before, _ = stages(), run()
    tasks = [x.apply(k) for x in (store.taskList(*s, 10_000) for s in stages() - before) for k in range(x.size())]
    return max(t.taskMetrics().get().peakExecutionMemory() for t in tasks if t.taskMetrics().isDefined()) / 1e6


def memory_of(spark, name):
    return most_of_a_task(spark, lambda: QUERIES[name](spark, LARGE).write.format("noop").mode("overwrite").save())


@needs_tables
def test_memory_of_nested_run(spark):
    """150,000 orders with their lines, customers and nations by four shuffle partitions."""
    assert memory_of(spark, "nest_run") < 120


@needs_tables
def test_memory_of_nested_lists(spark):
    """Orders without a line have an empty list."""
    assert memory_of(spark, "nest_empty_list") < 100


@needs_tables
def test_tasks_follow_the_tables(spark, monkeypatch):
    """Not the number of shuffle partitions, nor beyond what a page's rows need; without tables of a known size, that number."""
    dealt = lambda df: re.findall(r"hashpartitioning\(_k0_0[^,]*, (\d+)\), (\w+)", plan(df))
    spec = {"select": ["o_orderkey", {"lineitems": ["l_returnflag"]}]}
    monkeypatch.setattr(nesting, "TASK_BYTES", 1 << 18)
    size = sum(os.path.getsize(f"{LARGE}/{t}.parquet") for t in ("orders", "lineitem"))
    (tasks, kind), *_ = dealt(QueryBuilder(tables(spark, LARGE), "orders").build(**spec).nested_df())
    assert int(tasks) == -(-size // (1 << 18)) and kind == "REPARTITION_BY_NUM"
    (tasks, _), *_ = dealt(QueryBuilder(tables(spark, LARGE), "orders").build(**spec, limit=20).nested_df()) or [("1", "")]
    assert int(tasks) == 1
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(1,)], 1), "o_orderkey bigint")
    (tasks, kind), *_ = dealt(QueryBuilder(Catalog(spark, Entity("orders", dataframe(rows), ("o_orderkey",))), "orders").build().nested_df())
    assert (tasks, kind) == (spark.conf.get("spark.sql.shuffle.partitions"), "REPARTITION_BY_COL")


def test_objects_that_are_carried_are_the_same(spark):
    """To-one relations by unique keys, missing ones, ones all null and ones of a relation whose key isn't unique: as on the driver."""
    a = spark.createDataFrame([(1, 10, "x"), (2, 11, "y"), (3, None, "x"), (4, 12, "z"), (5, 10, "x")], "id bigint, b bigint, name string")
    b = spark.createDataFrame([(10, 100, "p"), (11, 101, None), (12, None, "r")], "id bigint, c bigint, name string")
    c = spark.createDataFrame([(100, "deep"), (101, "far")], "id bigint, name string")
    t = spark.createDataFrame([(k, 1 + k % 5, "st"[k % 2], 10 + k % 3) for k in range(15)], "id bigint, a bigint, tag string, b bigint")
    for unique in (True, False):
        catalog = Catalog(
            spark,
            Entity("a", dataframe(a), ("id",), {"b": Relation("b", (("b", "id"),), many=False), "tags": Relation("t", (("id", "a"),), many=True)}),
            Entity("b", dataframe(b), ("id",), {"c": Relation("c", (("c", "id"),), many=False)}, unique=unique),
            Entity("c", dataframe(c), ("id",)),
            Entity("t", dataframe(t), ("id",), {"b": Relation("b", (("b", "id"),), many=False)}),
        )
        for select in (["name", {"b": ["name", {"c": ["name"]}]}, {"tags": ["tag", {"b": ["name"]}]}], [{"b": [{"c": ["name"]}]}], ["id", {"tags": [{"b": ["name", {"c": ["name"]}]}, "tag"]}], [{"b": []}, "name"]):
            builder = QueryBuilder(catalog, "a").build(select=select, sort=["-id"], join_type="left")
            strip = lambda x: {k: strip(v) for k, v in x.items() if k != "_none"} if isinstance(x, dict) else [strip(y) for y in x] if isinstance(x, list) else x
            assert [strip(r.asDict(recursive=True)) for r in builder.nested_df().collect()] == builder.serialize(builder.fetch()), (unique, select)


@needs_tables
def test_memory_of_nested_levels(spark):
    """Customers with their orders with their lines."""
    assert memory_of(spark, "nest_two_levels") < 150
