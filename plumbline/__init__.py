"""Declarative queries over related tables, planned as Spark DataFrames."""

import logging

from .builder import QueryBuilder
from .errors import FieldNotFound
from .functions.predicates import CLASSES, Predicate, predicate
from .operators.filters import FilterBuilder
from .operators.grouping import DateGranularity, GroupByConfig, GroupedResponse, GroupKeyExtractor, GroupResult
from .operators.nesting import Record
from .operators.paging import PaginationInfo
from .settings import Settings, settings
from .sources.catalog import Catalog, Entity, Relation, dataframe, jdbc, parquet
from .spec import FieldSelection, JoinType, PaginatedResponse, QuerySpec

__all__ = [
    "Catalog", "DateGranularity", "Entity", "FieldNotFound", "FieldSelection", "FilterBuilder", "GroupByConfig", "GroupKeyExtractor", "GroupResult", "GroupedResponse", "JoinType", "PaginatedResponse", "PaginationInfo",
    "Predicate", "QueryBuilder", "QuerySpec", "Record", "Relation", "Settings", "dataframe", "jdbc", "parquet", "predicate", "settings",
    *CLASSES,
]

globals().update(CLASSES)  # a class for each operator: EqualPredicate and so on

logging.getLogger(__name__).setLevel(settings.LOG_LEVEL)
