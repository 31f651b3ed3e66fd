import json
from types import SimpleNamespace
from urllib.parse import quote, urlencode

import pytest
from pydantic import ValidationError

from plumbline import QuerySpec, Settings, settings
from plumbline.operators.paging import page_of

SPEC = dict(select=["id", "name"], filter={"age": {"gt": 25}}, sort=["-age"], limit=10, offset=0)
JSON = '{"select":["id","name"],"filter":{"age":{"gt":25}},"sort":["-age"],"limit":10,"offset":0,"include_pagination":false,"group_by":null,"join_type":null}'


def test_url_forms():
    spec = QuerySpec(**SPEC)
    assert spec.to_qs() == urlencode({"q": JSON})
    assert spec.to_query_param() == quote(JSON)
    for back in (QuerySpec.from_qs(spec.to_qs()), QuerySpec.from_qs("?" + spec.to_qs()), QuerySpec.from_qs({"q": JSON}), QuerySpec.from_query_param(spec.to_query_param()), QuerySpec.from_request(SimpleNamespace(query_params={"q": JSON}))):
        assert back == spec


def test_defaults():
    spec = QuerySpec.from_qs({})
    assert (spec.select, spec.filter, spec.sort, spec.limit, spec.offset, spec.include_pagination, spec.group_by, spec.join_type) == ([], {}, [], 10, 0, False, None, None)
    assert QuerySpec.from_qs({"q": ""}) == QuerySpec.from_qs("") == spec
    assert QuerySpec.from_qs({"q": '{"fil": {"a": 1}}'}).filter == {}
    assert QuerySpec(limit=None).limit is None


def test_bad_json():
    with pytest.raises(ValueError, match="Invalid JSON in query parameter"):
        QuerySpec.from_qs({"q": "{"})


@pytest.mark.parametrize("bad", [{"limit": 0}, {"limit": 201}, {"limit": -1}, {"offset": -1}, {"join_type": "cross"}, {"select": [1]}])
def test_limits(bad):
    with pytest.raises(ValidationError):
        QuerySpec(**bad)


@pytest.mark.parametrize(
    ("total", "size", "offset", "page", "pages", "before", "after"),
    [(7, 3, 0, 1, 3, None, 2), (7, 3, 6, 3, 3, 2, None), (7, 3, 300, 3, 3, 2, None), (0, 5, 0, 1, 1, None, None), (5, 2, 2, 2, 3, 1, 3), (6, 3, 3, 2, 2, 1, None), (1, 1, 0, 1, 1, None, None)],
)
def test_pages(total, size, offset, page, pages, before, after):
    p = page_of(total, size, offset)
    assert (p.total, p.size, p.page, p.pages, p.previous_page, p.next_page) == (total, size, page, pages, before, after)


def test_settings_from_environment():
    own = Settings.from_env({"PLUMBLINE_MAX_LIMIT": "50", "PLUMBLINE_DEFAULT_RETURN_PAGINATION": "true", "PLUMBLINE_DEFAULT_JOIN_TYPE": "left", "PLUMBLINE_FILTER_OPERATORS": json.dumps(["eq"]), "OTHER": "1"})
    assert (own.MAX_LIMIT, own.DEFAULT_RETURN_PAGINATION, own.DEFAULT_JOIN_TYPE, own.FILTER_OPERATORS, own.DEFAULT_LIMIT) == (50, True, "left", ["eq"], 10)
    assert len(settings.FILTER_OPERATORS) == len(set(settings.FILTER_OPERATORS)) == 50
