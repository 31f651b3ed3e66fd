"""A catalog of star-schema tables in a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, Entity, Relation, parquet


def one(target: str, *on: tuple[str, str]) -> Relation:
    return Relation(target, on, many=False)


def many(target: str, *on: tuple[str, str]) -> Relation:
    return Relation(target, on, many=True)


def tables(spark: SparkSession, folder: str) -> Catalog:
    at = lambda name: parquet(f"{folder}/{name}.parquet")

    def orders(session: SparkSession) -> DataFrame:
        df = at("orders")(session)
        more = {"is_open": F.col("o_orderstatus") == "O", "o_day": F.col("o_orderdate").cast("date"), "o_code": F.translate("o_orderpriority", "-", "\\")}
        return df.withColumns(more)

    return Catalog(
        spark,
        Entity("region", at("region"), ("r_regionkey",), {"nations": many("nation", ("r_regionkey", "n_regionkey"))}),
        Entity(
            "nation",
            at("nation"),
            ("n_nationkey",),
            {"region": one("region", ("n_regionkey", "r_regionkey")), "customers": many("customer", ("n_nationkey", "c_nationkey")), "suppliers": many("supplier", ("n_nationkey", "s_nationkey"))},
        ),
        Entity(
            "customer",
            at("customer"),
            ("c_custkey",),
            {"nation": one("nation", ("c_nationkey", "n_nationkey")), "orders": many("orders", ("c_custkey", "o_custkey")), "events": many("events", ("c_custkey", "user_id"))},
        ),
        Entity("supplier", at("supplier"), ("s_suppkey",), {"nation": one("nation", ("s_nationkey", "n_nationkey")), "lineitems": many("lineitem", ("s_suppkey", "l_suppkey"))}),
        Entity("part", at("part"), ("p_partkey",), {"lineitems": many("lineitem", ("p_partkey", "l_partkey"))}),
        Entity("orders", orders, ("o_orderkey",), {"customer": one("customer", ("o_custkey", "c_custkey")), "lineitems": many("lineitem", ("o_orderkey", "l_orderkey"))}),
        # No column or pair of columns tells lines apart; rows with all of these in common count as one object.
        Entity(
            "lineitem",
            at("lineitem"),
            ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"),
            {"order": one("orders", ("l_orderkey", "o_orderkey")), "part": one("part", ("l_partkey", "p_partkey")), "supplier": one("supplier", ("l_suppkey", "s_suppkey"))},
            unique=False,
        ),
        Entity("events", at("events"), ("event_id",), {"customer": one("customer", ("user_id", "c_custkey"))}),
        Entity("documents", at("documents"), ("doc_id",), {"labels": many("labels", ("doc_id", "doc_id"))}),
        Entity("labels", at("labels"), ("doc_id",), {"document": one("documents", ("doc_id", "doc_id"))}),
        Entity("pages", at("pages"), ("page_id",)),
        Entity("benchmark", at("benchmark"), ("item_id",)),
        Entity("conversations", at("conversations"), ("conv_id", "turn")),
        Entity("embeddings", at("embeddings"), ("vec_id",)),
    )
