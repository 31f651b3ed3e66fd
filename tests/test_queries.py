"""Every query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from plumbline.queries import QUERIES, SQL

from .oracle import same

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = os.environ.get("TEST_WHOLE_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, name):
    folder = LARGER if name == "page_paginated" else FOLDER  # its page is past the end of the smallest tables
    assert same(QUERIES[name](spark, folder), folder, SQL[name]) is None
