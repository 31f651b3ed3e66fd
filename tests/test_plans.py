"""What the plans look like: pushed filters, pruned columns, top-k operators, no Python."""

import os
import re

import pytest

from plumbline import GroupByConfig, QueryBuilder
from plumbline.queries import QUERIES
from plumbline.sources.tables import tables

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def builder(spark, entity, **spec):
    return QueryBuilder(tables(spark, FOLDER), entity).build(**spec)


def test_filters_and_columns_reach_the_scan(spark):
    found = plan(builder(spark, "orders", select=["o_orderkey"], filter={"o_totalprice": {"gt": 100000}, "o_orderdate": {"gte": "1996-01-01"}, "o_orderpriority": {"start": "1"}}).flat_df())
    pushed = re.search(r"PushedFilters: \[(.*)\]", found)[1]
    assert "GreaterThan(o_totalprice,100000.0)" in pushed and "GreaterThanOrEqual(o_orderdate" in pushed and "StringStartsWith(o_orderpriority,1)" in pushed
    assert set(re.findall(r"(o_\w+):", re.search(r"ReadSchema: struct<(.*)>", found)[1])) == {"o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"}


def test_a_page_is_a_top_k(spark):
    found = plan(builder(spark, "orders", select=["o_orderkey"], sort=["-o_totalprice"], limit=10, offset=5).flat_df())
    assert "TakeOrderedAndProject" in found and "Exchange rangepartitioning" not in found


def test_counts_need_no_distinct_where_keys_are_unique(spark):
    one = plan(builder(spark, "orders", filter={"customer.c_acctbal": {"gt": 0}}).count_df())
    many = plan(builder(spark, "customer", filter={"orders.o_totalprice": {"gt": 0}, "events.value": {"gt": 1}}).count_df())
    lines = plan(builder(spark, "lineitem", filter={"l_quantity": {"gt": 10}}).count_df())
    operators = lambda text, name: len(re.findall(rf"[- ]{name} \(\d+\)", text.split("\n\n")[0]))
    for text in (one, many):  # conditions on relations are semi-joins, which don't multiply
        assert operators(text, "HashAggregate") == 2 and "LeftSemi" in text
    assert operators(lines, "HashAggregate") > 2


def test_groups_are_cut_before_the_shuffle(spark):
    found = plan(builder(spark, "orders", select=["o_orderkey"], sort=["-o_totalprice"]).grouped_df(GroupByConfig(field="o_orderpriority"), 3))
    assert found.count("WindowGroupLimit (") == 2


def test_unselected_relations_are_semi_joins(spark):
    found = plan(builder(spark, "customer", select=["c_name"], filter={"orders.o_totalprice": {"gt": 350000}}).flat_df())
    assert "LeftSemi" in found and "Cartesian" not in found and "NestedLoop" not in found


def scans(df):
    return len(re.findall(r"Scan parquet", plan(df).split("\n\n")[0]))


def test_each_table_is_read_once(spark):
    """A filter along a relation reads it and the root; nested objects read what they are of."""
    assert scans(builder(spark, "orders", select=["o_orderkey"], filter={"customer.c_acctbal": {"gt": 0}}).flat_df()) == 2
    assert scans(builder(spark, "customer", select=["c_name"], filter={"or": [{"orders.o_totalprice": {"gt": 380000}}, {"c_acctbal": {"lt": -500}}]}).flat_df()) == 2
    assert scans(builder(spark, "customer", select=["c_name"], filter={"orders.o_totalprice": {"gt": 1}, "events.value": {"gt": 1}}).flat_df()) == 3
    assert scans(builder(spark, "orders", filter={"customer.nation.n_name": "NATION_3"}).count_df()) == 3
    four = builder(spark, "orders", select=["o_orderkey", {"customer": ["c_name", {"nation": ["n_name"]}]}, {"lineitems": ["l_returnflag"]}], sort=["-o_totalprice"]).nested_df()
    assert scans(four) == 4


def test_nesting_deals_rows_once(spark):
    """After the join, one exchange by the root's key, and one for the order of the result."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spec = {"select": ["o_orderkey", {"customer": ["c_name"]}, {"lineitems": ["l_returnflag"]}]}
        exchanges = lambda df: len(re.findall(r"[- ]Exchange \(\d+\)", plan(df).split("\n\n")[0]))
        assert exchanges(builder(spark, "orders", **spec).nested_df()) == exchanges(builder(spark, "orders", **spec).flat_df()) + 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pages_far_down_are_not_held_in_memory(spark):
    near, far = (plan(builder(spark, "orders", select=["o_orderkey"], sort=["-o_totalprice"], limit=10, offset=k).flat_df()) for k in (10, 10_000_000))
    assert "TakeOrderedAndProject" in near and "TakeOrderedAndProject" not in far


def jobs(spark, run):
    group = f"count-{id(run)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_grouped_run_does_not_ask_for_each_group(spark):
    """One query for the keys and one for the rows of 5 or 80 groups; Spark may take some jobs for one of them."""
    from plumbline import QuerySpec

    catalog = tables(spark, FOLDER)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # each stage of an adaptive plan is a job of its own
        few, many = (jobs(spark, lambda f=f: QuerySpec(select=["o_orderkey"], limit=3, group_by=f).run_grouped(catalog, "orders")) for f in ("o_orderpriority", {"field": "o_orderdate", "granularity": "month"}))
        assert few <= 6 and many <= 6
        assert jobs(spark, lambda: QuerySpec(select=["o_orderkey"], limit=3).run_paginated(catalog, "orders")) == 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_hot_keys_are_split(spark):
    """A join on a key that nearly all rows have: adaptive planning splits its partition."""
    from pyspark.sql import functions as F

    from plumbline import Catalog, Entity, Relation, dataframe

    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        lines = spark.range(60_000, numPartitions=8).select(F.col("id"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("root"), F.md5(F.col("id").cast("string")).alias("body"))
        roots = spark.range(60_000).select("id", F.md5(F.col("id").cast("string")).alias("name"))
        catalog = Catalog(spark, Entity("line", dataframe(lines), ("id",), {"root": Relation("root", (("root", "id"),), many=False)}), Entity("root", dataframe(roots), ("id",)))
        df = QueryBuilder(catalog, "line").build(select=["body", {"root": ["name"]}]).flat_df("_")
        df.write.format("noop").mode("overwrite").save()
        done = df._jdf.queryExecution().executedPlan()
        assert df.count() == 60_000 and "skew" in _final(spark, df).lower(), done
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _final(spark, df):
    """The plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_left_joins_become_inner_if_a_filter_asks_for_matches(spark):
    found = plan(builder(spark, "orders", select=["o_orderkey", {"customer": ["c_name"]}], filter={"customer.c_acctbal": {"gt": 0}}, join_type="left").flat_df())
    assert "LeftOuter" not in found


def test_no_python_on_the_executors(spark):
    for name in ("pred_i_cont_any", "join_three_levels", "join_filter_unselected_or_root", "nest_two_levels", "group_half_hour_zone", "group_keys_to_many_path", "count_relation_or_root"):
        assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan(QUERIES[name](spark, FOLDER))), name
