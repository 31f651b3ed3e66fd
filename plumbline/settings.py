"""Defaults and limits. Each can be set by an environment variable of the same name with the prefix ``PLUMBLINE_``."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

PREFIX = "PLUMBLINE_"
JOIN_TYPES = ("inner", "left", "outer")
# The names of the 50 filter operators.
FILTER_OPERATORS = (
    "eq ne gt lt gte lte cont starts_with ends_with in nin is_null is_not_null "
    "matches does_not_match matches_any matches_all does_not_match_any does_not_match_all present blank "
    "lt_any lteq_any gt_any gteq_any lt_all lteq_all gt_all gteq_all not_eq_all "
    "start not_start start_any start_all not_start_any not_start_all end not_end end_any end_all not_end_any not_end_all "
    "i_cont i_cont_any i_cont_all not_i_cont not_i_cont_any not_i_cont_all true false"
).split()


@dataclass
class Settings:
    DEFAULT_LIMIT: int = 10
    MAX_LIMIT: int = 200
    DEFAULT_OFFSET: int = 0
    QUERY_PARAM_NAME: str = "q"
    SELECT_PARAM_NAME: str = "select"
    FILTER_PARAM_NAME: str = "filter"
    SORT_PARAM_NAME: str = "sort"
    LIMIT_PARAM_NAME: str = "limit"
    OFFSET_PARAM_NAME: str = "offset"
    PAGINATION_PARAM_NAME: str = "include_pagination"
    GROUP_BY_PARAM_NAME: str = "group_by"
    JOIN_TYPE_PARAM_NAME: str = "join_type"
    DEFAULT_RETURN_PAGINATION: bool = False
    DEFAULT_JOIN_TYPE: str = "inner"
    LOG_LEVEL: str = "INFO"
    FILTER_OPERATORS: list[str] = field(default_factory=lambda: list(FILTER_OPERATORS))
    SUPPORTED_DATE_GRANULARITIES: list[str] = field(default_factory=lambda: ["year", "month", "day", "hour", "minute"])

    @classmethod
    def from_env(cls, env=os.environ) -> Settings:
        out = cls()
        for f in fields(cls):
            if (raw := env.get(PREFIX + f.name)) is not None:
                now = getattr(out, f.name)
                value = raw.lower() in ("1", "true", "yes", "on") if isinstance(now, bool) else int(raw) if isinstance(now, int) else json.loads(raw) if isinstance(now, list) else raw
                setattr(out, f.name, value)
        return out


settings = Settings.from_env()
