"""What users extend and set: predicate classes, key expressions, settings, databases."""

import decimal
import logging
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

import plumbline
from plumbline import Catalog, Entity, GroupByConfig, GroupKeyExtractor, Predicate, QueryBuilder, QuerySpec, Relation, dataframe, jdbc, settings
from plumbline.functions.predicates import CLASSES, registry
from plumbline.operators.nesting import nest
from plumbline.settings import FILTER_OPERATORS, Settings


def test_a_class_for_each_operator(spark):
    assert {c.name for c in CLASSES.values()} == set(FILTER_OPERATORS) and len(CLASSES) == 50
    for name in ("EqualPredicate", "GreaterThanOrEqualPredicate", "NotInPredicate", "StartsWithPredicate", "LteqAllPredicate", "NotIContAnyPredicate", "TruePredicate"):
        assert issubclass(getattr(plumbline, name), Predicate) and name in plumbline.__all__
    df = spark.createDataFrame([("apple",), ("pear",), (None,)], "name string")
    rows = lambda test: [r.name for r in df.where(test).collect()]
    assert rows(plumbline.ContainsPredicate().apply(F.col("name"), "pp")) == ["apple"]
    assert rows(plumbline.IsNullPredicate().apply(F.col("name"), True)) == [None]
    assert rows(plumbline.EndAnyPredicate().apply(F.col("name"), ["le", "ar"])) == ["apple", "pear"]


def test_own_predicate_class(catalog):
    class LongerThan(Predicate):
        name = "longer_than"

        def apply(self, column, value):
            return F.length(column) > value

    settings.FILTER_OPERATORS.append("longer_than")
    try:
        assert [x["name"] for x in QuerySpec(select=["name"], filter={"name": {"longer_than": 5}}).run(catalog, "user")] == ["Charlie"]
    finally:
        settings.FILTER_OPERATORS.remove("longer_than")
        del registry["longer_than"]
    with pytest.raises(ValueError, match="Unsupported operator"):
        QuerySpec(filter={"name": {"longer_than": 5}}).run(catalog, "user")
    with pytest.raises(TypeError):

        class Unfinished(Predicate):
            pass

        Unfinished()


def test_key_expressions(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-31 23:30:00' AS at, 5 AS n")
    key = GroupKeyExtractor("postgresql").get_group_key_expression
    assert df.select(key(F.col("n"), GroupByConfig(field="n"))).first()[0] == 5
    config = GroupByConfig(field="at", granularity="month", timezone="Europe/Paris")
    assert df.select(key(F.col("at"), config), key(F.col("at"), config, TimestampNTZType())).first() == ("2024-02", "2024-02")


def test_settings_from_the_environment():
    """Names of parameters, of the query in URLs and the log level are read when the package is."""
    code = "import logging, plumbline; s = plumbline.QuerySpec.model_validate({'fields': ['a'], 'where': {'b': 1}, 'top': 3}); print(s.select, s.filter, s.limit, s.to_qs().partition('=')[0], logging.getLogger('plumbline').level)"
    env = {"PLUMBLINE_SELECT_PARAM_NAME": "fields", "PLUMBLINE_FILTER_PARAM_NAME": "where", "PLUMBLINE_LIMIT_PARAM_NAME": "top", "PLUMBLINE_QUERY_PARAM_NAME": "query", "PLUMBLINE_LOG_LEVEL": "ERROR"}
    import os

    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | env | {"PYTHONPATH": os.getcwd()})
    assert got.stdout.strip() == f"['a'] {{'b': 1}} 3 query {logging.ERROR}", got.stderr[-500:]
    made = Settings.from_env({"PLUMBLINE_SORT_PARAM_NAME": "by", "PLUMBLINE_MAX_LIMIT": "7", "PLUMBLINE_DEFAULT_RETURN_PAGINATION": "yes", "PLUMBLINE_FILTER_OPERATORS": '["eq"]'})
    assert (made.SORT_PARAM_NAME, made.MAX_LIMIT, made.DEFAULT_RETURN_PAGINATION, made.FILTER_OPERATORS) == ("by", 7, True, ["eq"])


@pytest.mark.parametrize("n", [3, 80])
def test_equal_children_whatever_their_number(spark, n):
    """One rule for few children and many: 0.0 and -0.0 are one value, decimals are their numbers, not-a-number is itself."""
    nan, one = float("nan"), decimal.Decimal
    values = [(0.0, one("1.0"), nan), (-0.0, one("1.00"), nan), (0.0, one("1.000"), nan)]
    some = [(k, 1, *values[k % 3]) for k in range(n)] + [(n, 1, 5.0, one("1"), nan)]
    roots, parts = spark.createDataFrame([(1, "r")], "id bigint, name string"), spark.createDataFrame(some, "id bigint, root bigint, x double, y decimal(9,3), z double")
    catalog = Catalog(spark, Entity("root", dataframe(roots), ("id",), {"parts": Relation("part", (("id", "root"),), many=True)}), Entity("part", dataframe(parts), ("id",)))
    builder = QueryBuilder(catalog, "root").build(select=["name", {"parts": ["x", "y", "z"]}], sort=["parts.id"])
    (record,), (row,) = builder.fetch(), builder.nested_df().collect()
    for got in (record["parts"], row.parts):
        assert [(p["x"], p["y"], p["z"] != p["z"]) for p in got] == [(0.0, 1, True), (5.0, 1, True)]
    assert nest([], builder.plan().root) == []


def test_wide_nesting_in_spark_and_on_the_driver(catalog):
    """Siblings, levels below them, empty lists and conditions across them: both ways give the same."""
    for spec in (
        {"select": ["name", {"posts": ["title", {"comments": ["body"]}]}], "sort": ["id", "posts.id"], "join_type": "left"},
        {"select": [{"posts": [{"comments": ["body"]}, "status"]}], "sort": ["-id"], "join_type": "left"},
        {"select": ["name", {"posts": []}], "sort": ["id"], "join_type": "left"},
        {"select": ["status", {"posts": ["status"]}], "sort": ["id"], "filter": {"or": [{"age": {"gt": 30}}, {"posts.status": "draft"}]}},
    ):
        builder = QueryBuilder(catalog, "user").build(**spec)
        strip = lambda x: {k: strip(v) for k, v in x.items() if k != "_none"} if isinstance(x, dict) else [strip(y) for y in x] if isinstance(x, list) else x
        assert [strip(r.asDict(recursive=True)) for r in builder.nested_df().collect()] == builder.serialize(builder.fetch()), spec


def test_distinct_rows_in_order(catalog):
    builder = QueryBuilder(catalog, "post").build(select=["title", {"user": ["name"]}], sort=["-id"])
    assert [tuple(r) for r in builder.exec_df().collect()] == builder.exec() and len(builder.exec()) == 5


DERBY = "jdbc:derby:memory:shop;create=true"


@pytest.fixture(scope="module")
def database(spark):
    df = spark.range(1000).selectExpr("id AS ID", "id % 7 AS KIND", "concat('name ', id) AS NAME")
    df.write.format("jdbc").options(url=DERBY, dbtable="ITEMS", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    spark.range(7).selectExpr("id AS ID", "concat('kind ', id) AS LABEL").write.format("jdbc").options(url=DERBY, dbtable="KINDS", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    return {"url": DERBY, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_database_tables(spark, database):
    """Reads in parts by a column, filters pushed down, joins of two tables."""
    catalog = Catalog(spark, Entity("item", jdbc(table="ITEMS", partition_column="ID", partitions=5, **database), ("ID",), {"kind": Relation("kind", (("KIND", "ID"),), many=False)}), Entity("kind", jdbc(table="KINDS", **database), ("ID",)))
    assert catalog.frame("item").rdd.getNumPartitions() == 5 and catalog.frame("kind").rdd.getNumPartitions() == 1
    builder = QueryBuilder(catalog, "item").build(select=["NAME", {"kind": ["LABEL"]}], filter={"ID": {"gte": 995}}, sort=["-ID"])
    assert builder.serialize(builder.fetch()) == [{"NAME": f"name {k}", "kind": {"LABEL": f"kind {k % 7}"}} for k in range(999, 994, -1)]
    assert builder.count() == 5
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThanOrEqual(ID,995)" in spark._jvm.PythonSQLUtils.explainString(builder.flat_df()._jdf.queryExecution(), "formatted")


def test_empty_database_table(spark, database):
    spark.range(0).selectExpr("id AS ID").write.format("jdbc").options(dbtable="NOTHING", **database).mode("overwrite").save()
    assert jdbc(table="NOTHING", partition_column="ID", **database)(spark).count() == 0
