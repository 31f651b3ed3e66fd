"""A query for each operator of the query layer over star-schema tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .builder import QueryBuilder
from .operators.grouping import GroupByConfig
from .sources.tables import tables
from .spec import QuerySpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def flat(name: str, entity: str, sql: str, **spec: Any) -> None:
    """A query whose rows are the flat rows of a spec; dots in names become underscores."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return QueryBuilder(tables(spark, folder), entity).build(**spec).flat_df("_")

    QUERIES[name], SQL[name] = run, sql


def spec(name: str, entity: str, sql: str, raw: dict[str, Any]) -> None:
    """The same from a validated spec, through its URL form."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return QuerySpec.from_qs(QuerySpec.model_validate(raw).to_qs()).builder(tables(spark, folder), entity).flat_df("_")

    QUERIES[name], SQL[name] = run, sql


# -- predicates: name -> (entity, column, value, SQL condition)

PREDICATES: dict[str, tuple[str, str, Any, str]] = {
    "eq": ("orders", "o_orderstatus", "F", "o_orderstatus = 'F'"),
    "ne": ("orders", "o_orderstatus", "F", "o_orderstatus <> 'F'"),
    "gt": ("orders", "o_totalprice", 300000.5, "o_totalprice > 300000.5"),
    "lt": ("orders", "o_totalprice", 20000.5, "o_totalprice < 20000.5"),
    "gte": ("orders", "o_custkey", 1200, "o_custkey >= 1200"),
    "lte": ("orders", "o_custkey", 77, "o_custkey <= 77"),
    "cont": ("part", "p_name", "e%b", "p_name LIKE '%e%b%'"),
    "starts_with": ("orders", "o_orderpriority", "1-", "o_orderpriority LIKE '1-%'"),
    "ends_with": ("part", "p_name", "ring", "p_name LIKE '%ring'"),
    "in": ("orders", "o_custkey", [3, 5, 8, 13, 21], "o_custkey IN (3, 5, 8, 13, 21)"),
    "nin": ("orders", "o_orderstatus", ["F", "O"], "o_orderstatus NOT IN ('F', 'O')"),
    "is_null": ("orders", "lineitems.l_quantity", True, "l_quantity IS NULL"),
    "is_not_null": ("orders", "lineitems.l_quantity", True, "l_quantity IS NOT NULL"),
    "matches": ("orders", "o_orderpriority", "_-%H", "o_orderpriority LIKE '_-%H'"),
    "does_not_match": ("orders", "o_orderpriority", "%I%", "o_orderpriority NOT LIKE '%I%'"),
    "matches_any": ("orders", "o_orderpriority", ["1%", "%LOW"], "(o_orderpriority LIKE '1%' OR o_orderpriority LIKE '%LOW')"),
    "matches_all": ("orders", "o_orderpriority", ["%-%", "%E%"], "(o_orderpriority LIKE '%-%' AND o_orderpriority LIKE '%E%')"),
    "does_not_match_any": ("orders", "o_orderpriority", ["1%", "%LOW"], "(o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '%LOW')"),
    "does_not_match_all": ("orders", "o_orderpriority", ["%-%", "%E%"], "(o_orderpriority NOT LIKE '%-%' OR o_orderpriority NOT LIKE '%E%')"),
    "present": ("part", "p_type", True, "(p_type IS NOT NULL AND p_type <> '')"),
    "blank": ("orders", "lineitems.l_returnflag", True, "(l_returnflag IS NULL OR l_returnflag = '')"),
    "lt_any": ("orders", "o_totalprice", [5000, 20000], "(o_totalprice < 5000 OR o_totalprice < 20000)"),
    "lteq_any": ("orders", "o_custkey", [5, 20], "(o_custkey <= 5 OR o_custkey <= 20)"),
    "gt_any": ("orders", "o_custkey", [1400, 1450], "(o_custkey > 1400 OR o_custkey > 1450)"),
    "gteq_any": ("orders", "o_custkey", [1400, 1450], "(o_custkey >= 1400 OR o_custkey >= 1450)"),
    "lt_all": ("orders", "o_custkey", [50, 20], "(o_custkey < 50 AND o_custkey < 20)"),
    "lteq_all": ("orders", "o_custkey", [50, 20], "(o_custkey <= 50 AND o_custkey <= 20)"),
    "gt_all": ("orders", "o_custkey", [1400, 1450], "(o_custkey > 1400 AND o_custkey > 1450)"),
    "gteq_all": ("orders", "o_custkey", [1400, 1450], "(o_custkey >= 1400 AND o_custkey >= 1450)"),
    "not_eq_all": ("orders", "o_orderstatus", ["F", "P"], "(o_orderstatus <> 'F' AND o_orderstatus <> 'P')"),
    "start": ("part", "p_type", "S", "p_type LIKE 'S%'"),
    "not_start": ("part", "p_type", "S", "p_type NOT LIKE 'S%'"),
    "start_any": ("orders", "o_orderpriority", ["1", "2"], "(o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%')"),
    "start_all": ("orders", "o_orderpriority", ["1", "1-U"], "(o_orderpriority LIKE '1%' AND o_orderpriority LIKE '1-U%')"),
    "not_start_any": ("orders", "o_orderpriority", ["1", "2"], "(o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '2%')"),
    "not_start_all": ("orders", "o_orderpriority", ["1", "1-U"], "(o_orderpriority NOT LIKE '1%' OR o_orderpriority NOT LIKE '1-U%')"),
    "end": ("part", "p_name", "bolt", "p_name LIKE '%bolt'"),
    "not_end": ("part", "p_name", "bolt", "p_name NOT LIKE '%bolt'"),
    "end_any": ("part", "p_name", ["ring", "bolt"], "(p_name LIKE '%ring' OR p_name LIKE '%bolt')"),
    "end_all": ("part", "p_name", ["t", "bolt"], "(p_name LIKE '%t' AND p_name LIKE '%bolt')"),
    "not_end_any": ("part", "p_name", ["ring", "bolt"], "(p_name NOT LIKE '%ring' AND p_name NOT LIKE '%bolt')"),
    "not_end_all": ("part", "p_name", ["t", "bolt"], "(p_name NOT LIKE '%t' OR p_name NOT LIKE '%bolt')"),
    "i_cont": ("orders", "o_orderpriority", "hIgH", "o_orderpriority ILIKE '%hIgH%'"),
    "i_cont_any": ("orders", "o_orderpriority", ["high", "low"], "(o_orderpriority ILIKE '%high%' OR o_orderpriority ILIKE '%low%')"),
    "i_cont_all": ("orders", "o_orderpriority", ["h", "-hi"], "(o_orderpriority ILIKE '%h%' AND o_orderpriority ILIKE '%-hi%')"),
    "not_i_cont": ("orders", "o_orderpriority", "hIgH", "o_orderpriority NOT ILIKE '%hIgH%'"),
    "not_i_cont_any": ("orders", "o_orderpriority", ["high", "low"], "(o_orderpriority NOT ILIKE '%high%' AND o_orderpriority NOT ILIKE '%low%')"),
    "not_i_cont_all": ("orders", "o_orderpriority", ["h", "-hi"], "(o_orderpriority NOT ILIKE '%h%' OR o_orderpriority NOT ILIKE '%-hi%')"),
    "true": ("orders", "is_open", True, "o_orderstatus = 'O'"),
    "false": ("orders", "is_open", True, "o_orderstatus <> 'O'"),
}

for _name, (_entity, _column, _value, _sql) in PREDICATES.items():
    _key = {"orders": "o_orderkey", "part": "p_partkey"}[_entity]
    if _column.startswith("lineitems."):
        flat(
            f"pred_{_name}",
            "orders",
            f"SELECT o_orderkey, l_partkey AS lineitems_l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE {_sql}",
            select=["o_orderkey", {"lineitems": ["l_partkey"]}],
            filter={_column: {_name: _value}},
            join_type="left",
        )
    else:
        _shown = _column if _column != "is_open" else "o_orderstatus"
        flat(f"pred_{_name}", _entity, f"SELECT {_key}, {_shown} FROM {_entity} WHERE {_sql}", select=[_key, _shown], filter={_column: {_name: _value}})

# -- the filter language


def _filter(name: str, filters: dict[str, Any], condition: str) -> None:
    flat(f"filter_{name}", "orders", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {condition}", select=["o_orderkey", "o_totalprice"], filter=filters)


_filter("implicit_eq", {"o_orderstatus": "P"}, "o_orderstatus = 'P'")
_filter("implicit_eq_null", {"o_orderstatus": None}, "o_orderstatus IS NULL")
_filter("implicit_and", {"o_orderstatus": "O", "o_orderpriority": {"start": "1"}}, "o_orderstatus = 'O' AND o_orderpriority LIKE '1%'")
_filter("multi_op", {"o_totalprice": {"gte": 100000, "lt": 150000}}, "o_totalprice >= 100000 AND o_totalprice < 150000")
_filter("and", {"and": [{"o_custkey": {"lt": 500}}, {"o_orderstatus": "F"}]}, "o_custkey < 500 AND o_orderstatus = 'F'")
_filter("or", {"or": [{"o_custkey": {"lt": 50}}, {"o_orderstatus": "P"}]}, "o_custkey < 50 OR o_orderstatus = 'P'")
_filter("or_flatten", {"or": [{"o_custkey": {"gte": 1000, "lt": 300}}, {"o_orderstatus": "P", "o_totalprice": {"lt": 9000}}]}, "o_custkey >= 1000 OR o_custkey < 300 OR o_orderstatus = 'P' OR o_totalprice < 9000")
_filter(
    "nested_and_or",
    {"or": [{"and": [{"o_custkey": {"lt": 100}}, {"o_orderstatus": "F"}]}, {"and": [{"o_custkey": {"gt": 1400}}, {"or": [{"o_orderstatus": "O"}, {"o_totalprice": {"gt": 400000}}]}]}]},
    "(o_custkey < 100 AND o_orderstatus = 'F') OR (o_custkey > 1400 AND (o_orderstatus = 'O' OR o_totalprice > 400000))",
)
_filter("empty", {}, "true")
_filter("empty_or", {"or": [], "o_orderstatus": "P"}, "o_orderstatus = 'P'")
_filter("in_empty", {"o_custkey": {"in": []}}, "false")
_filter("nin_empty", {"o_custkey": {"nin": []}}, "true")
_filter("nin_null", {"o_custkey": {"nin": [1, None]}}, "o_custkey NOT IN (1, NULL)")
_filter("any_empty", {"o_orderpriority": {"start_any": []}, "o_custkey": {"lt": 90}}, "o_custkey < 90")
_filter("backslash", {"o_code": {"cont": "1\\U"}}, "contains(replace(o_orderpriority, '-', '\\'), '1\\U')")
_filter("datetime_iso", {"o_orderdate": {"gte": "1996-03-01T00:00:00", "lt": "1996-04-01"}}, "o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-04-01'")
_filter("datetime_zone", {"o_orderdate": {"gt": "1997-01-01T02:00:00+02:00"}}, "o_orderdate > TIMESTAMP '1997-01-01'")
_filter("datetime_z", {"o_orderdate": {"lteq_any": ["1995-02-01T00:00:00Z"]}}, "o_orderdate <= TIMESTAMP '1995-02-01'")
_filter("datetime_in", {"o_orderdate": {"in": ["1996-01-02", "1996-01-03T00:00:00Z"]}}, "o_orderdate IN (TIMESTAMP '1996-01-02', TIMESTAMP '1996-01-03')")
_filter("datetime_object", {"o_orderdate": {"gt": {"$date": "2000-06-01T00:00:00Z"}}}, "o_orderdate > TIMESTAMP '2000-06-01'")
_filter("date_column", {"o_day": {"gte": "1999-12-30", "lte": "2000-01-02T10:00:00"}}, "CAST(o_orderdate AS DATE) BETWEEN DATE '1999-12-30' AND DATE '2000-01-02'")

# -- joins

_LINES = "FROM orders JOIN lineitem ON l_orderkey = o_orderkey"
flat("join_inner", "orders", f"SELECT o_orderkey, l_quantity AS lineitems_l_quantity {_LINES}", select=["o_orderkey", {"lineitems": ["l_quantity"]}])
for _name in ("left", "outer"):
    flat(
        f"join_{_name}",
        "orders",
        "SELECT o_orderkey, l_quantity AS lineitems_l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey",
        select=["o_orderkey", {"lineitems": ["l_quantity"]}],
        join_type=_name,
    )
flat(
    "join_to_one",
    "orders",
    "SELECT o_orderkey, c_name AS customer_c_name, c_acctbal AS customer_c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey",
    select=["o_orderkey", {"customer": ["c_name", "c_acctbal"]}],
)
flat(
    "join_siblings",
    "customer",
    "SELECT c_custkey, o_orderkey AS orders_o_orderkey, event_id AS events_event_id FROM customer JOIN orders ON o_custkey = c_custkey JOIN events ON user_id = c_custkey",
    select=["c_custkey", {"orders": ["o_orderkey"]}, {"events": ["event_id"]}],
)
flat(
    "join_three_levels",
    "nation",
    "SELECT n_name, c_custkey AS customers_c_custkey, o_orderkey AS customers_orders_o_orderkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey",
    select=["n_name", {"customers": ["c_custkey", {"orders": ["o_orderkey"]}]}],
)
flat(
    "join_same_entity_twice",
    "lineitem",
    """SELECT l_orderkey, a.n_name AS order_customer_nation_n_name, b.n_name AS supplier_nation_n_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
      JOIN nation a ON a.n_nationkey = c_nationkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE l_quantity < 3""",
    select=["l_orderkey", {"order": [{"customer": [{"nation": ["n_name"]}]}]}, {"supplier": [{"nation": ["n_name"]}]}],
    filter={"l_quantity": {"lt": 3}},
)
flat(
    "join_left_filter_root",
    "customer",
    "SELECT c_custkey, event_id AS events_event_id FROM customer LEFT JOIN events ON user_id = c_custkey WHERE c_acctbal < 0",
    select=["c_custkey", {"events": ["event_id"]}],
    filter={"c_acctbal": {"lt": 0}},
    join_type="left",
)
flat(
    "join_left_is_null_anti",
    "documents",
    "SELECT doc_id, NULL::BIGINT AS labels_quality FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    select=["doc_id", {"labels": ["quality"]}],
    filter={"labels.doc_id": {"is_null": True}},
    join_type="left",
)
flat(
    "join_filter_selected_relation",
    "customer",
    "SELECT c_custkey, o_orderkey AS orders_o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 350000",
    select=["c_custkey", {"orders": ["o_orderkey"]}],
    filter={"orders.o_totalprice": {"gt": 350000}},
)
flat(
    "join_filter_unselected_relation",
    "customer",
    "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000 AND o_orderstatus = 'F')",
    select=["c_custkey", "c_name"],
    filter={"orders.o_totalprice": {"gt": 350000}, "orders.o_orderstatus": "F"},
)
flat(
    "join_filter_unselected_or_root",
    "customer",
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_totalprice > 380000 OR c_acctbal < -500))",
    select=["c_custkey"],
    filter={"or": [{"orders.o_totalprice": {"gt": 380000}}, {"c_acctbal": {"lt": -500}}]},
)
flat(
    "join_filter_below_selected",
    "customer",
    "SELECT c_custkey, o_orderkey AS orders_o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)",
    select=["c_custkey", {"orders": ["o_orderkey"]}],
    filter={"orders.lineitems.l_quantity": {"gt": 49}},
)
flat(
    "join_filter_to_one_path",
    "orders",
    "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name = 'NATION_3'",
    select=["o_orderkey"],
    filter={"customer.nation.n_name": "NATION_3"},
)

# -- select

flat("select_fields", "nation", "SELECT n_regionkey, n_name FROM nation", select=["n_regionkey", "n_name"])
flat("select_default", "supplier", "SELECT * FROM supplier")
flat("select_wildcard", "part", "SELECT * FROM part", select=["p_size", "*"])
flat("select_twice", "nation", "SELECT n_name, n_nationkey FROM nation", select=["n_name", "n_nationkey", "n_name"])
flat("select_without_key", "orders", "SELECT o_orderstatus, o_orderpriority FROM orders", select=["o_orderstatus", "o_orderpriority"])
flat(
    "select_nested_wildcard",
    "nation",
    "SELECT n_name, r_name AS region_r_name, r_regionkey AS region_r_regionkey FROM nation JOIN region ON r_regionkey = n_regionkey",
    select=["n_name", {"region": ["*"]}],
)
flat("select_unknown_relation", "nation", "SELECT n_name FROM nation", select=["n_name", {"nothing": ["x"]}])

# -- sort and page: SQL's window numbers the rows, so that order is part of the result


def _placed(df: DataFrame) -> DataFrame:
    """The rows of a sorted frame and place, their number in its order; a row for each partition comes to the driver."""
    # Kept, as the bounds of the partitions may be others when the rows are sorted again.
    kept = df.withColumn("_at", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    part = F.shiftright("_at", 33)
    starts, begin = [], 0
    for r in kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((r.part, begin))
        begin += r.n
    ahead = df.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(ahead), part == F.col("_part")).select(place.alias("place"), *df.columns)


def _sorted(name: str, sort: list[Any], order: str, joins: str = "") -> None:
    """The place of every row in the order."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _placed(QueryBuilder(tables(spark, folder), "orders").build(select=["o_orderkey", "o_totalprice"], sort=sort).flat_df("_"))

    QUERIES[name] = run
    SQL[name] = f"SELECT row_number() OVER (ORDER BY {order}, o_orderkey) - 1 AS place, o_orderkey, o_totalprice FROM orders {joins}"


def _paged(name: str, sort: list[Any], order: str, limit: int, offset: int | None = None, filters: dict[str, Any] | None = None, where: str = "true") -> None:
    """A page: its rows with their places in it."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = QueryBuilder(tables(spark, folder), "orders").build(select=["o_orderkey", "o_totalprice"], filter=filters, sort=sort, limit=limit, offset=offset).flat_df("_")
        return _placed(df)

    QUERIES[name] = run
    SQL[name] = f"""SELECT (row_number() OVER (ORDER BY n)) - 1 AS place, o_orderkey, o_totalprice FROM
      (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY {order}, o_orderkey) AS n FROM orders WHERE {where})
      WHERE n > {offset or 0} AND n <= {(offset or 0) + limit}"""


_sorted("sort_asc", ["o_totalprice"], "o_totalprice")
_sorted("sort_plus", ["+o_orderpriority"], "o_orderpriority")
_sorted("sort_desc", ["-o_totalprice"], "o_totalprice DESC")
_sorted("sort_multi", ["-o_orderpriority", "o_orderstatus", "-o_custkey"], "o_orderpriority DESC, o_orderstatus, o_custkey DESC")
_sorted("sort_unselected", ["-o_orderdate"], "o_orderdate DESC")
_sorted("sort_none", [], "o_orderkey")
_sorted("sort_to_one_path", ["-customer.c_acctbal"], "c_acctbal DESC", joins="LEFT JOIN customer ON c_custkey = o_custkey")
_CUSTOM = "CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 3 END"
_sorted("sort_custom", [{"o_orderstatus": ["P", "F"]}], _CUSTOM)
_sorted("sort_custom_values", [{"o_orderstatus": {"values": ["P", "F"]}}, "-o_totalprice"], f"{_CUSTOM}, o_totalprice DESC")
_sorted("sort_custom_path", [{"customer.c_mktsegment": ["MACHINERY", "BUILDING"]}, "-o_totalprice"], "CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 3 END, o_totalprice DESC", joins="LEFT JOIN customer ON c_custkey = o_custkey")
_sorted("sort_custom_order", [{"o_orderstatus": {"order": ["P", "F"]}}, "o_custkey"], f"{_CUSTOM}, o_custkey")
_paged("page_limit", ["o_orderkey"], "o_orderkey", limit=7)
_paged("page_offset", ["o_orderkey"], "o_orderkey", limit=7, offset=14)
_paged("page_topk_filtered", ["-o_totalprice"], "o_totalprice DESC", limit=10, filters={"o_orderstatus": "F", "o_totalprice": {"gt": 100000}}, where="o_orderstatus = 'F' AND o_totalprice > 100000")
flat(
    "page_limit_on_joined_rows",
    "orders",
    f"SELECT o_orderkey, l_partkey AS lineitems_l_partkey {_LINES} ORDER BY o_orderkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 50 OFFSET 20",
    select=["o_orderkey", {"lineitems": ["l_partkey"]}],
    sort=["o_orderkey"],
    limit=50,
    offset=20,
)


def _counted(name: str, entity: str, sql: str, filters: dict[str, Any] | None = None, **options: Any) -> None:
    QUERIES[name] = lambda spark, folder: QueryBuilder(tables(spark, folder), entity).build(filter=filters, **options).count_df()
    SQL[name] = f"SELECT {sql}"


_counted("count_all", "orders", "count(*) AS total FROM orders")
_counted("count_filtered", "orders", "count(*) AS total FROM orders WHERE o_totalprice > 250000", {"o_totalprice": {"gt": 250000}})
_counted("count_ignores_joins_and_page", "customer", "count(*) AS total FROM customer", select=["c_name", {"events": ["event_id"]}], limit=3)
_counted("count_relation_filter", "customer", "count(DISTINCT c_custkey) AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000", {"orders.o_totalprice": {"gt": 300000}})
_counted(
    "count_relation_or_root",
    "customer",
    "count(DISTINCT c_custkey) AS total FROM customer JOIN events ON user_id = c_custkey WHERE value > 90 OR c_acctbal < 0",
    {"or": [{"events.value": {"gt": 90}}, {"c_acctbal": {"lt": 0}}]},
)


def _paginated(spark: SparkSession, folder: str) -> DataFrame:
    page = QuerySpec(select=["o_orderkey"], filter={"o_orderstatus": "P"}, limit=20, offset=45).run_paginated(tables(spark, folder), "orders")
    p = page.pagination
    return spark.createDataFrame([(len(page.items), p.total, p.page, p.size, p.pages, p.previous_page, p.next_page)], "items bigint, total bigint, page bigint, size bigint, pages bigint, previous_page bigint, next_page bigint")


QUERIES["page_paginated"] = _paginated
SQL["page_paginated"] = """SELECT greatest(least(total - 45, 20), 0) AS items, total, CAST(3 AS BIGINT) AS page, CAST(20 AS BIGINT) AS size,
  CAST(ceil(total / 20) AS BIGINT) AS pages, CAST(2 AS BIGINT) AS previous_page, CASE WHEN 3 < ceil(total / 20) THEN CAST(4 AS BIGINT) END AS next_page
  FROM (SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'P')"""



def _page_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of 20 of one total: the first, one that begins in the middle of another, the last and one beyond it; and of nothing."""
    catalog = tables(spark, folder)
    total, rows = QueryBuilder(catalog, "customer").build().count(), []
    for name, offset, filters in (("first", 0, None), ("between", 30, None), ("last", (total - 1) // 20 * 20, None), ("beyond", total + 500, None), ("nothing", 40, {"c_custkey": {"lt": 0}})):
        got = QuerySpec(select=["c_custkey"], filter=filters, limit=20, offset=offset).run_paginated(catalog, "customer")
        p = got.pagination
        rows.append((name, len(got.items), p.total, p.page, p.size, p.pages, p.previous_page, p.next_page))
    return spark.createDataFrame(rows, "state string, items bigint, total bigint, page bigint, size bigint, pages bigint, previous_page bigint, next_page bigint")


QUERIES["page_edges"] = _page_edges
SQL["page_edges"] = """WITH t AS (SELECT count(*) AS n, CAST(ceil(count(*) / 20) AS BIGINT) AS m FROM customer)
  SELECT 'first' AS state, least(n, 20) AS items, n AS total, CAST(1 AS BIGINT) AS page, CAST(20 AS BIGINT) AS size, m AS pages, CAST(NULL AS BIGINT) AS previous_page, CASE WHEN m > 1 THEN CAST(2 AS BIGINT) END AS next_page FROM t
  UNION ALL SELECT 'between', greatest(least(n - 30, 20), 0), n, least(2, m), 20, m, CASE WHEN m > 1 THEN 1 END, CASE WHEN m > 2 THEN 3 END FROM t
  UNION ALL SELECT 'last', n - 20 * (m - 1), n, m, 20, m, CASE WHEN m > 1 THEN m - 1 END, NULL FROM t
  UNION ALL SELECT 'beyond', 0, n, m, 20, m, CASE WHEN m > 1 THEN m - 1 END, NULL FROM t
  UNION ALL SELECT 'nothing', 0, 0, 1, 20, 1, NULL, NULL"""

# -- nested results, flattened again


def _nested(spark: SparkSession, folder: str) -> DataFrame:
    builder = QueryBuilder(tables(spark, folder), "customer").build(select=["c_custkey", {"orders": ["o_orderstatus", {"lineitems": ["l_returnflag"]}]}])
    rows = builder.nested_df().select("c_custkey", F.posexplode("orders").alias("place", "o"))
    return rows.select("c_custkey", F.size("o.lineitems").cast("long").alias("n_flags")).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("n_flags").alias("n_flags"))


QUERIES["nest_two_levels"] = _nested
SQL["nest_two_levels"] = """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, list_sort(list_distinct(list(l_returnflag))) AS flags, string_agg(l_returnflag, '' ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS seen
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
  -- children are equal if their fields are, lists in the order of their first rows included
  d AS (SELECT DISTINCT o_custkey, o_orderstatus, list_distinct(flags) AS f, list_reduce(string_split(seen, ''), lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || x END) AS first_seen FROM o)
  SELECT o_custkey AS c_custkey, count(*) AS n_orders, CAST(sum(len(f)) AS BIGINT) AS n_flags FROM d GROUP BY o_custkey"""


def _nested_run(spark: SparkSession, folder: str) -> DataFrame:
    """All orders with a line, in order, as objects with their relations; the result stays in Spark."""
    builder = QueryBuilder(tables(spark, folder), "orders").build(select=["o_orderkey", {"customer": ["c_name", {"nation": ["n_name"]}]}, {"lineitems": ["l_returnflag"]}], sort=["-o_totalprice"])
    placed = _placed(builder.nested_df())
    return placed.select("place", "o_orderkey", F.col("customer.c_name").alias("c_name"), F.col("customer.nation.n_name").alias("n_name"), F.size("lineitems").cast("long").alias("n_flags"))


QUERIES["nest_run"] = _nested_run
SQL["nest_run"] = """SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place, o_orderkey, c_name, n_name, count(DISTINCT l_returnflag) AS n_flags
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_totalprice, o_orderkey, c_name, n_name"""


def _nested_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page of 150 joined rows, put together on the driver as run() does."""
    got = QuerySpec(select=["o_orderkey", {"customer": ["c_name", {"nation": ["n_name"]}]}, {"lineitems": ["l_returnflag"]}], sort=["-o_totalprice"], limit=150).run(tables(spark, folder), "orders")
    rows = [(x["o_orderkey"], x["customer"]["c_name"], x["customer"]["nation"]["n_name"], len(x["lineitems"])) for x in got]
    return spark.createDataFrame(rows, "o_orderkey bigint, c_name string, n_name string, n_flags bigint")


QUERIES["page_nested"] = _nested_page
SQL["page_nested"] = """WITH page AS (SELECT o_orderkey, c_name, n_name, l_returnflag FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN lineitem ON l_orderkey = o_orderkey
    ORDER BY o_totalprice DESC, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 150)
  SELECT o_orderkey, c_name, n_name, count(DISTINCT l_returnflag) AS n_flags FROM page GROUP BY ALL"""


def _nested_left(spark: SparkSession, folder: str) -> DataFrame:
    """Objects without a child have an empty list."""
    df = QueryBuilder(tables(spark, folder), "orders").build(select=["o_orderkey", {"lineitems": ["l_linestatus"]}], join_type="left").nested_df()
    return df.select("o_orderkey", F.size("lineitems").cast("long").alias("n_statuses"))


QUERIES["nest_empty_list"] = _nested_left
SQL["nest_empty_list"] = "SELECT o_orderkey, count(DISTINCT l_linestatus) AS n_statuses FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"


def _distinct(spark: SparkSession, folder: str) -> DataFrame:
    return QueryBuilder(tables(spark, folder), "orders").build(select=["o_orderpriority", {"customer": ["c_mktsegment"]}]).exec_df("_")


QUERIES["exec_distinct"] = _distinct
SQL["exec_distinct"] = "SELECT DISTINCT o_orderpriority, c_mktsegment AS customer_c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey"

# -- groups


def _grouped(name: str, entity: str, group_by: Any, sql_key: str, *, select: list[Any], filters: dict[str, Any] | None = None, where: str = "true", sort: list[Any] | None = None, order: str, limit: int = 3, offset: int = 0, source: str | None = None) -> None:
    columns = ", ".join(select)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return QueryBuilder(tables(spark, folder), entity).build(select=select, filter=filters, sort=sort).grouped_df(GroupByConfig.from_param(group_by), limit, offset, "_")

    QUERIES[name] = run
    SQL[name] = f"""SELECT key, CAST(n AS INTEGER) AS rank, {columns} FROM (SELECT {sql_key} AS key, {columns}, row_number() OVER (PARTITION BY {sql_key} ORDER BY {order}) AS n
      FROM {source or entity} WHERE {where}) WHERE n > {offset} AND n <= {offset + limit}"""


def _keys(name: str, entity: str, group_by: Any, sql: str, filters: dict[str, Any] | None = None) -> None:
    QUERIES[name] = lambda spark, folder: QueryBuilder(tables(spark, folder), entity).build(filter=filters).group_keys_df(GroupByConfig.from_param(group_by))
    SQL[name] = sql


_grouped("group_plain", "orders", "o_orderpriority", "o_orderpriority", select=["o_orderkey", "o_totalprice"], order="o_orderkey")
_grouped("group_sorted", "orders", "o_orderpriority", "o_orderpriority", select=["o_orderkey"], sort=["-o_totalprice"], order="o_totalprice DESC, o_orderkey", limit=5)
_grouped("group_offset", "orders", {"field": "o_orderstatus"}, "o_orderstatus", select=["o_orderkey"], sort=["o_custkey"], order="o_custkey, o_orderkey", limit=4, offset=3)
_grouped("group_filtered", "orders", "o_orderstatus", "o_orderstatus", select=["o_orderkey"], filters={"o_totalprice": {"gt": 300000}}, where="o_totalprice > 300000", order="o_orderkey")
_grouped("group_to_one_path", "orders", "customer.c_mktsegment", "c_mktsegment", select=["o_orderkey"], order="o_orderkey", source="orders JOIN customer ON c_custkey = o_custkey")
_FORMATS = {"year": "%Y", "month": "%Y-%m", "day": "%Y-%m-%d", "hour": "%Y-%m-%dT%H", "minute": "%Y-%m-%dT%H:%M"}
for _name, _format in _FORMATS.items():
    _grouped(f"group_{_name}", "events", {"field": "ts", "granularity": _name}, f"strftime(ts, '{_format}')", select=["event_id"], sort=["-value"], order="value DESC, event_id", limit=2)
for _name, _config, _minutes in (("tz_offset", {"tz_offset": -3}, -180), ("zone", {"timezone": "Asia/Tokyo"}, 540), ("half_hour_zone", {"timezone": "Asia/Kolkata"}, 330)):
    _key_sql = f"strftime(ts + INTERVAL ({_minutes}) MINUTE, '%Y-%m-%dT%H')"
    _grouped(f"group_{_name}", "events", {"field": "ts", "granularity": "HOUR", **_config}, _key_sql, select=["event_id"], order="event_id", limit=2)
_keys("group_keys", "orders", "o_orderpriority", "SELECT o_orderpriority AS key, count(*) AS total FROM orders GROUP BY 1")
_keys("group_keys_date", "orders", {"field": "o_orderdate", "granularity": "month"}, "SELECT strftime(o_orderdate, '%Y-%m') AS key, count(*) AS total FROM orders GROUP BY 1")
_keys(
    "group_keys_to_many_path",
    "customer",
    "orders.o_orderstatus",
    "SELECT o_orderstatus AS key, count(DISTINCT c_custkey) AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1",
    {"c_acctbal": {"gt": 0}},
)


def _capped(spark: SparkSession, folder: str) -> DataFrame:
    got = QuerySpec(select=["o_orderkey"], sort=["-o_totalprice"], limit=60, group_by="o_orderpriority").run_grouped(tables(spark, folder), "orders")
    rows = [(g["key"], x["o_orderkey"], g["pagination"]["total"], g["pagination"]["pages"], got["truncated"]) for g in got["groups"] for x in g["items"]]
    return spark.createDataFrame(rows, "key string, o_orderkey bigint, total bigint, pages bigint, truncated boolean")


QUERIES["group_run_capped"] = _capped
SQL["group_run_capped"] = """WITH r AS (SELECT o_orderpriority AS key, o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) AS total, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders),
  c AS (SELECT *, row_number() OVER (ORDER BY key, n) AS m FROM r WHERE n <= 60)
  SELECT key, o_orderkey, total, CAST(ceil(total / 60) AS BIGINT) AS pages, true AS truncated FROM c WHERE m <= 200"""



def _group_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The third page of 7 of each group, with its place among the group's pages."""
    got = QuerySpec(select=["o_orderkey"], sort=["-o_totalprice"], limit=7, offset=14, group_by="o_orderstatus").run_grouped(tables(spark, folder), "orders")
    rows = [(g["key"], x["o_orderkey"], *(g["pagination"][c] for c in ("total", "page", "size", "pages", "previous_page", "next_page")), got["truncated"]) for g in got["groups"] for x in g["items"]]
    return spark.createDataFrame(rows, "key string, o_orderkey bigint, total bigint, page bigint, size bigint, pages bigint, previous_page bigint, next_page bigint, truncated boolean")


QUERIES["group_pages"] = _group_pages
SQL["group_pages"] = """WITH r AS (SELECT o_orderstatus AS key, o_orderkey, count(*) OVER (PARTITION BY o_orderstatus) AS total, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders),
  p AS (SELECT *, CAST(ceil(total / 7) AS BIGINT) AS pages FROM r WHERE n > 14 AND n <= 21)
  SELECT key, o_orderkey, total, CAST(3 AS BIGINT) AS page, CAST(7 AS BIGINT) AS size, pages, CAST(2 AS BIGINT) AS previous_page, CASE WHEN pages > 3 THEN CAST(4 AS BIGINT) END AS next_page, false AS truncated FROM p"""

# -- a whole spec by way of its URL form

spec(
    "spec_url",
    "orders",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    {"select": ["o_orderkey", "o_totalprice"], "filter": {"o_orderstatus": "F", "o_totalprice": {"gt": 100000}}, "sort": ["-o_totalprice"], "limit": 10, "unknown": 1},
)
