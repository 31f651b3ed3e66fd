"""Selection, joins, nesting, order, pages and groups on users and posts."""

import asyncio
import logging
from datetime import datetime

import pytest

from plumbline import FieldNotFound, GroupByConfig, QueryBuilder, QuerySpec
from plumbline.operators.selection import tree
from plumbline.streaming import stream

from .data import POST, USERS, catalog_of


def run(catalog, entity="user", **spec):
    return QuerySpec(**spec).run(catalog, entity)


def names(catalog, **spec):
    return [x["name"] for x in run(catalog, select=["name"], **spec)]


def test_select(catalog):
    assert run(catalog, select=["name", "id", "name"], limit=1, sort=["id"]) == [{"name": "Alice", "id": 1}]
    assert list(run(catalog, limit=1)[0]) == catalog.fields("user")
    assert list(run(catalog, select=["age", "*"], limit=1)[0]) == sorted(catalog.fields("user"))
    assert [list(x) for x in run(catalog, select=[{"posts": ["title", "id"]}, "id"], limit=1)] == [["id", "posts"]]
    with pytest.raises(FieldNotFound):
        run(catalog, select=["nothing"])


def test_unknown_relation_is_left_out(catalog, caplog):
    with caplog.at_level(logging.WARNING, "plumbline"):
        assert run(catalog, select=["id", {"nothing": ["x"]}], limit=1, sort=["id"]) == [{"id": 1}]
    assert "nothing" in caplog.text
    node = tree(catalog, catalog.entity("user"), [{"posts": ["*"]}])
    assert node.children["posts"].fields == sorted(catalog.fields("post"))


def test_keys_are_not_needed_to_tell_objects_apart(catalog):
    assert run(catalog, select=["is_active"], sort=["id"]) == [{"is_active": True}, {"is_active": True}, {"is_active": False}, {"is_active": True}, {"is_active": False}]
    assert run(catalog, select=["status"], sort=["id"]) == [{"status": x} for x in ("active", "active", "inactive", "pending")]  # all null: none


def test_inner_and_left_joins(catalog):
    want = {1: ["Python Tips", "Python Tricks"], 2: ["Rust Intro"], 3: ["Rust Intro"]}
    got = run(catalog, select=["id", {"posts": ["title"]}], sort=["id"])
    assert {x["id"]: [p["title"] for p in x["posts"]] for x in got} == want | {4: []}
    for kind in ("left", "outer"):
        got = run(catalog, select=["id", {"posts": ["title"]}], sort=["id"], join_type=kind)
        assert {x["id"]: [p["title"] for p in x["posts"]] for x in got} == want | {4: [], 5: []}
    assert [x["id"] for x in run(catalog, select=["id", {"posts": ["title"]}], sort=["id"], filter={"age": {"lt": 35}}, join_type="left")] == [1, 2, 4, 5]
    with pytest.raises(ValueError, match="Invalid join_type"):
        QueryBuilder(catalog, "user").apply_select(["id"], join_type="cross")


def test_to_one(catalog):
    assert run(catalog, "post", select=["id", {"user": ["name"]}], limit=2, sort=["-id"]) == [{"id": 6, "user": {"name": "Bob"}}, {"id": 5, "user": {"name": "Diana"}}]
    orphan = catalog_of(catalog.spark, posts=[(1, "t", "c", "s", 99, datetime(2024, 1, 1))])
    assert run(orphan, "post", select=["id", {"user": ["name"]}]) == []
    assert run(orphan, "post", select=["id", {"user": ["name"]}], join_type="left") == [{"id": 1, "user": None}]


def test_three_levels_and_frames(catalog):
    spec = QuerySpec(select=["name", {"posts": ["title", {"comments": ["body"]}]}], sort=["id", "posts.id"], join_type="left")
    want = [
        {"name": "Alice", "posts": [{"title": "Python Tips", "comments": [{"body": "fine"}, {"body": "good"}]}, {"title": "Python Tricks", "comments": []}]},
        {"name": "Bob", "posts": [{"title": "Rust Intro", "comments": [{"body": "fine"}]}]},
        {"name": "Charlie", "posts": [{"title": "Rust Intro", "comments": []}]},
        {"name": "Diana", "posts": []},
        {"name": "Eve", "posts": []},
    ]
    assert spec.run(catalog, "user") == want
    assert [r.asDict(recursive=True) for r in spec.builder(catalog, "user").nested_df().collect()] == want


def test_siblings_do_not_multiply(catalog):
    got = run(catalog, "post", select=["id", {"comments": ["body"]}, {"user": ["name"]}], sort=["id"])
    assert got[0] == {"id": 1, "comments": [{"body": "fine"}, {"body": "good"}], "user": {"name": "Alice"}}


def test_empty_relation_list(catalog):
    assert run(catalog, select=["id", {"posts": []}], sort=["id"], limit=1) == [{"id": 1, "posts": [{}]}]


def test_limit_counts_joined_rows(catalog):
    got = run(catalog, select=["id", {"posts": ["id"]}], sort=["id", "posts.id"], limit=3)
    assert got == [{"id": 1, "posts": [{"id": 1}, {"id": 2}]}, {"id": 2, "posts": [{"id": 3}]}]
    page = QuerySpec(select=["id", {"posts": ["id"]}], limit=3).run_paginated(catalog, "user")
    assert page.pagination.total == 5


def test_relation_filters(catalog):
    assert run(catalog, select=["id", {"posts": ["id"]}], filter={"posts.title": {"cont": "Rust"}}, sort=["id"]) == [{"id": 2, "posts": [{"id": 3}, {"id": 6}]}, {"id": 3, "posts": [{"id": 4}]}]
    assert [x["id"] for x in run(catalog, select=["id"], filter={"posts.title": {"cont": "Rust"}}, sort=["id"])] == [2, 3]
    assert [x["id"] for x in run(catalog, select=["id"], filter={"posts.title": {"cont": "Python"}, "posts.status": "draft"})] == [1]
    assert run(catalog, select=["id"], filter={"posts.title": {"cont": "Rust"}, "posts.status": "archived"}) == []
    assert [x["id"] for x in run(catalog, select=["id"], filter={"posts.comments.body": "fine"}, sort=["id"])] == [1, 2]
    got = run(catalog, select=["id", {"posts": ["id"]}], filter={"posts.comments.body": "good"})
    assert got == [{"id": 1, "posts": [{"id": 1}]}]  # the post that has the comment, not its siblings
    assert [x["id"] for x in run(catalog, select=["id", {"posts": ["id"]}], filter={"posts.id": {"is_null": 1}}, join_type="left")] == [5]
    count = lambda f: QueryBuilder(catalog, "user").build(filter=f).count()
    assert (count({"posts.title": {"cont": "Rust"}}), count({"posts.comments.body": "fine"}), count({}), count({"age": {"gt": 100}})) == (2, 2, 5, 0)


def test_sort(catalog):
    assert names(catalog, sort=["-age"]) == ["Charlie", "Eve", "Bob", "Diana", "Alice"]
    assert names(catalog, sort=["status", "+name"]) == ["Eve", "Alice", "Bob", "Charlie", "Diana"]
    assert names(catalog, sort=["-status", "-name"]) == ["Diana", "Charlie", "Bob", "Alice", "Eve"]
    assert names(catalog, sort=[{"name": ["Eve", "Alice", "Bob"]}]) == ["Eve", "Alice", "Bob", "Charlie", "Diana"]
    assert names(catalog, sort=[{"status": {"values": ["pending", "active"]}}, "-id"]) == ["Diana", "Bob", "Alice", "Eve", "Charlie"]
    assert names(catalog, sort=[{"status": {"order": ["inactive"]}}, "name"]) == ["Charlie", "Alice", "Bob", "Diana", "Eve"]
    assert names(catalog, sort=[{"created_at": ["2024-03-01T08:00:00Z"]}, "id"])[0] == "Eve"
    assert names(catalog, sort=[{"name": "Eve"}, {"a": [], "b": []}, 7, {"name": []}, "id"]) == [u[1] for u in USERS]
    with pytest.raises(FieldNotFound):
        names(catalog, sort=["nothing"])
    with pytest.raises(FieldNotFound):
        names(catalog, sort=["posts.title"])
    assert [x["id"] for x in run(catalog, "post", select=["id"], sort=["-user.name", "id"])] == [5, 4, 3, 6, 1, 2]


def test_builder(catalog):
    b = QueryBuilder(catalog, "user").apply_select(["id"]).apply_filter({"age": {"gt": 26}}).apply_sort(["id"]).apply_limit(2).apply_offset(1)
    assert b.fetch() == [{"id": 3}, {"id": 4}] and b.fetch()[0].id == 3
    assert b.exec() == [(3,), (4,)] and b.count() == 4
    assert b.apply_limit(0).apply_offset(None).exec() == [(2,), (3,), (4,), (5,)]
    assert (b.apply_limit(-5).limit, b.apply_offset(-5).offset) == (10, 0)
    assert QueryBuilder(catalog, "user").build(select=["is_active"], sort=["id"]).exec() == [(True,), (False,)]
    assert type(b.serialize(b.fetch())[0]) is dict
    with pytest.raises(AttributeError):
        b.fetch()[0].nothing  # noqa: B018


def test_paginated(catalog):
    page = QuerySpec(select=["id"], limit=2, offset=2, sort=["id"]).run_paginated(catalog, "user")
    assert page.items == [{"id": 3}, {"id": 4}]
    assert page.pagination.model_dump() == {"total": 5, "page": 2, "size": 2, "pages": 3, "previous_page": 1, "next_page": 3}


def test_async(catalog):
    spec = QuerySpec(select=["id"], sort=["id"], limit=2, group_by="is_active")
    b = spec.builder(catalog, "user")
    config = GroupByConfig(field="is_active")

    async def all_of_them():
        return await asyncio.gather(
            spec.run_async(catalog, "user"), spec.run_raw_async(catalog, "user"), spec.run_async_paginated(catalog, "user"), spec.run_grouped_async(catalog, "user"),
            b.fetch_async(), b.exec_async(), b.count_async(), b.get_distinct_group_keys_async(config), b.fetch_for_group_async(config, True), b.count_for_group_async(config, True),
        )

    got = asyncio.run(all_of_them())
    assert got[0] == got[1] == got[4] == got[2].items == [{"id": 1}, {"id": 2}]
    assert got[3] == spec.run_grouped(catalog, "user")
    assert got[5:] == [[(1,), (2,)], 5, [(False, 2), (True, 3)], [{"id": 1}, {"id": 2}, {"id": 4}], 3]


# -- groups


def grouped(catalog, entity="user", **spec):
    got = QuerySpec(**spec).run_grouped(catalog, entity)
    return [(g["key"], [x["id"] for x in g["items"]], g["pagination"]["total"]) for g in got["groups"]], got["truncated"]


def test_group_by_field(catalog):
    assert grouped(catalog, select=["id"], group_by="status", sort=["-id"]) == ([(None, [5], 1), ("active", [2, 1], 2), ("inactive", [3], 1), ("pending", [4], 1)], False)
    assert grouped(catalog, select=["id"], group_by={"field": "is_active"}, limit=1, offset=1, sort=["id"]) == ([("False", [5], 2), ("True", [2], 3)], False)
    assert grouped(catalog, select=["id"], group_by="status", filter={"age": {"gt": 29}}) == ([(None, [5], 1), ("active", [2], 1), ("inactive", [3], 1)], False)
    with pytest.raises(ValueError, match="group_by parameter is required"):
        QuerySpec().run_grouped(catalog, "user")


@pytest.mark.parametrize(
    ("config", "want"),
    [
        ({"granularity": "year"}, [("2024", [1, 2, 3, 4, 5])]),
        ({"granularity": "MONTH"}, [("2024-01", [1, 2]), ("2024-02", [3, 4]), ("2024-03", [5])]),
        ({"granularity": "month", "tz_offset": -9}, [("2024-01", [1, 2]), ("2024-02", [3, 4, 5])]),
        ({"granularity": "day", "timezone": "Asia/Kolkata"}, [("2024-01-15", [1]), ("2024-01-20", [2]), ("2024-02-10", [3]), ("2024-02-16", [4]), ("2024-03-01", [5])]),
        ({"granularity": "hour", "tz_offset": 5.5}, [("2024-01-15T16", [1]), ("2024-01-20T20", [2]), ("2024-02-10T14", [3]), ("2024-02-16T05", [4]), ("2024-03-01T13", [5])]),
        ({"granularity": "minute"}, [("2024-01-15T10:30", [1]), ("2024-01-20T14:45", [2]), ("2024-02-10T09:00", [3]), ("2024-02-15T23:30", [4]), ("2024-03-01T08:00", [5])]),
    ],
)
def test_group_by_date(catalog, config, want):
    got, _ = grouped(catalog, select=["id"], group_by={"field": "created_at", **config}, sort=["id"])
    assert [(k, x) for k, x, _ in got] == want


def test_zoned_times_and_dates_as_keys(catalog):
    got, _ = grouped(catalog, select=["id"], group_by={"field": "last_login", "granularity": "day", "tz_offset": 1}, sort=["id"])
    assert [(k, x) for k, x, _ in got] == [(None, [2, 3, 5]), ("2024-03-01", [1]), ("2024-03-02", [4])]
    got, _ = grouped(catalog, select=["id"], group_by={"field": "birth_date", "granularity": "year"}, sort=["id"])
    assert [(k, x) for k, x, _ in got] == [(None, [2, 5]), ("1989", [3]), ("1996", [4]), ("1999", [1])]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_whole_times_as_keys(spark, catalog, zone):
    """Times without a zone are the same keys in any session's zone."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got, _ = grouped(catalog, select=["id"], group_by="created_at")
        assert [x for _, x, _ in got] == [[1], [2], [3], [4], [5]] and got[0][0] == "2024-01-15 10:30:00"
        got, _ = grouped(catalog, select=["id"], group_by={"field": "created_at", "granularity": "hour", "tz_offset": -3}, limit=1)
        assert got[0][0] == "2024-01-15T07"
        b = QueryBuilder(catalog, "user").build(select=["id"])
        config = GroupByConfig(field="created_at")
        assert b.fetch_for_group(config, datetime(2024, 1, 20, 14, 45)) == [{"id": 2}] and b.count_for_group(config, datetime(2024, 1, 20, 14, 45)) == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_group_by_relation(catalog):
    assert grouped(catalog, "post", select=["id"], group_by="user.name", sort=["id"])[0] == [("Alice", [1, 2], 2), ("Bob", [3, 6], 2), ("Charlie", [4], 1), ("Diana", [5], 1)]
    assert grouped(catalog, select=["id"], group_by="posts.status", sort=["id"])[0] == [("archived", [4], 1), ("draft", [1, 3], 2), ("published", [1, 2], 2)]


def test_totals_ignore_joins(catalog):
    """A group whose roots have no posts is there, without items."""
    assert grouped(catalog, select=["id", {"posts": ["id"]}], group_by="status")[0][0] == (None, [], 1)


def test_cap_over_groups(spark):
    users = USERS + [(100 + k, f"u{k}", "", k, True, f"s{k % 5}", datetime(2024, 1, 1), None, None) for k in range(240)]
    got = QuerySpec(select=["id"], group_by="status", limit=60).run_grouped(catalog_of(spark, users=users), "user")
    sizes = {g["key"]: len(g["items"]) for g in got["groups"]}
    # null, active, inactive and pending fill 5; then 48 of each.
    assert sizes == {None: 1, "active": 2, "inactive": 1, "pending": 1, "s0": 48, "s1": 48, "s2": 48, "s3": 48, "s4": 3}
    assert got["truncated"] is True  # s3 might have had 51 by then and has fewer
    got = QuerySpec(select=["id"], group_by="is_active", limit=150).run_grouped(catalog_of(spark, users=users), "user")
    assert [len(g["items"]) for g in got["groups"]] == [2, 150] and got["truncated"] is False
    got = QuerySpec(select=["id"], group_by="is_active", limit=199, sort=["-id"]).run_grouped(catalog_of(spark, users=users), "user")
    assert [len(g["items"]) for g in got["groups"]] == [2, 198] and got["truncated"] is False  # cut, but filled as far as it may be
    many = USERS + [(1000 + k, f"u{k}", "", k, True, f"t{k:04}", datetime(2024, 1, 1), None, None) for k in range(450)]
    got = QuerySpec(select=["id"], group_by="status", limit=2).run_grouped(catalog_of(spark, users=many), "user")
    assert sum(len(g["items"]) for g in got["groups"]) == 200 and got["truncated"] is True
    got = QuerySpec(select=["id"], group_by="status", limit=2, offset=1).run_grouped(catalog_of(spark, users=many), "user")
    assert len(got["groups"]) == 454 and got["truncated"] is False  # most groups have no second row; all are looked at


def test_group_settings():
    assert GroupByConfig.from_param("a").field == "a" and not GroupByConfig.from_param("a").is_date_grouping
    assert GroupByConfig(field="a", granularity="Day", timezone="America/Sao_Paulo").offset_hours() == -3
    assert GroupByConfig(field="a").offset_hours() == 0
    for bad in ({"granularity": "week"}, {"granularity": 3}, {"timezone": "Mars/Base"}, {"tz_offset": 1, "timezone": "UTC"}):
        with pytest.raises(ValueError):
            GroupByConfig.from_param({"field": "a", **bad})


# -- streams


def test_stream(spark, catalog, tmp_path):
    spark.createDataFrame([(1, "t", "c", "draft", 1, datetime(2024, 1, 1)), (2, "u", "c", "live", 2, datetime(2024, 1, 1))], POST).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(POST).parquet(f"{tmp_path}/in")
    found = stream(QuerySpec(select=["id", {"user": ["name"]}], filter={"status": "live"}), catalog, "post", rows)
    query = found.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("streamed").collect()] == [(2, "Bob")]
    for spec in (QuerySpec(sort=["id"]), QuerySpec(select=["id", {"comments": ["id"]}])):
        with pytest.raises(ValueError, match="stream"):
            stream(spec, catalog, "post", rows)
