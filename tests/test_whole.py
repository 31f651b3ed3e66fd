"""Queries over whole tables: no part is left out, and orders are whole."""

import os
import re

import pytest

from plumbline.queries import QUERIES, SQL

from .oracle import rows_of_sql, same

FOLDER = os.environ.get("TEST_WHOLE_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
SORTS = sorted(x for x in QUERIES if x.startswith("sort_"))


def test_inner_join_has_all_lines(spark):
    got = QUERIES["join_inner"](spark, FOLDER)
    assert got.count() == rows_of_sql(FOLDER, "SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey")[1][0][0]
    assert same(got, FOLDER, SQL["join_inner"]) is None


def test_nesting_has_all_customers_with_lines(spark):
    got = QUERIES["nest_two_levels"](spark, FOLDER)
    assert got.count() == rows_of_sql(FOLDER, "SELECT count(DISTINCT o_custkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey")[1][0][0]
    assert same(got, FOLDER, SQL["nest_two_levels"]) is None


@pytest.mark.parametrize("name", SORTS)
def test_every_row_has_its_place(spark, name):
    got = QUERIES[name](spark, FOLDER)
    assert got.count() == rows_of_sql(FOLDER, "SELECT count(*) FROM orders")[1][0][0]
    assert same(got, FOLDER, SQL[name]) is None


def test_custom_order_places_all_values(spark):
    got = {r.o_orderkey: r.place for r in QUERIES["sort_custom"](spark, FOLDER).collect()}
    status = dict(rows_of_sql(FOLDER, "SELECT o_orderkey, o_orderstatus FROM orders")[1])
    ends = {s: [min(p for k, p in got.items() if status[k] == s), max(p for k, p in got.items() if status[k] == s)] for s in set(status.values())}
    assert set(ends) == {"P", "F", "O"} and ends["P"][1] < ends["F"][0] and ends["F"][1] < ends["O"][0]


def test_nested_run_is_in_order(spark):
    assert same(QUERIES["nest_run"](spark, FOLDER), FOLDER, SQL["nest_run"]) is None


def test_sorts_run_in_full(spark):
    """No top-k, and no window over a single partition."""
    df = QUERIES["sort_desc"](spark, FOLDER)
    found = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "rangepartitioning" in found and "TakeOrderedAndProject" not in found and "Window" not in found


#: Predicates whose test holds for all rows of these tables, or for none, as there are no such values in them.
ALL_OR_NOTHING = {"pred_present", "pred_is_null", "pred_blank", "pred_is_not_null", "filter_empty", "filter_nin_empty", "filter_in_empty", "filter_implicit_eq_null", "filter_nin_null"}


@pytest.mark.parametrize("name", sorted(x for x in QUERIES if re.match("pred_|filter_", x)))
def test_a_predicate_that_is_always_true_or_false_would_fail(name):
    """The SQL's rows are some of the table's, but not all."""
    sql = SQL[name]
    some, whole = len(rows_of_sql(FOLDER, sql)[1]), len(rows_of_sql(FOLDER, sql[: sql.rindex(" WHERE ")])[1])
    assert name in ALL_OR_NOTHING or 0 < some < whole
