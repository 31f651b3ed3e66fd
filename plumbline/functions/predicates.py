"""Filter predicates: name -> function of (column, its type, value) that gives a condition.

None in place of a condition means that there is none: an empty list in an ``_any`` or ``_all`` predicate
leaves no trace. Wildcards in patterns are live; backslashes are themselves."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

Test = Callable[[Column, DataType, Any], Column | None]
registry: dict[str, Test] = {}


def predicate(name: str) -> Callable[[Test], Test]:
    """Register a predicate under a name; it also has to be among the settings' FILTER_OPERATORS to be used."""

    def register(test: Test) -> Test:
        registry[name] = test
        return test

    return register


def fold_any(conditions: Iterable[Column | None]) -> Column | None:
    found = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a | b, found) if found else None


def fold_all(conditions: Iterable[Column | None]) -> Column | None:
    found = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, found) if found else None


def _needs(value: Any) -> Any:
    if value is None:
        raise ValueError("this operator needs a value that is not null")
    return value


def _text(column: Column, kind: DataType) -> Column:
    return column if isinstance(kind, StringType) else column.cast("string")


def _like(shape: str, *, fold_case: bool = False, negate: bool = False) -> Test:
    """LIKE with the value put into the shape in place of v."""

    def test(column: Column, kind: DataType, value: Any) -> Column:
        pattern = shape.replace("v", str(_needs(value)).replace("\\", "\\\\"))
        found = _text(column, kind).ilike(pattern) if fold_case else _text(column, kind).like(pattern)
        return ~found if negate else found

    return test


def _each(test: Test, fold: Callable) -> Test:
    return lambda column, kind, values: fold([test(column, kind, v) for v in values])


def _equal(column: Column, kind: DataType, value: Any) -> Column:
    return column.isNull() if value is None else column == value


def _unequal(column: Column, kind: DataType, value: Any) -> Column:
    return column.isNotNull() if value is None else column != value


def _filled(column: Column, kind: DataType, _: Any) -> Column:
    return column.isNotNull() & (column != "") if isinstance(kind, StringType) else column.isNotNull()


def _blank(column: Column, kind: DataType, _: Any) -> Column:
    return column.isNull() | (column == "") if isinstance(kind, StringType) else column.isNull()


COMPARISONS: dict[str, Callable[[Column, Any], Column]] = {
    "lt": lambda c, v: c < v,
    "lteq": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "gteq": lambda c, v: c >= v,
}


def _compare(name: str) -> Test:
    return lambda column, kind, value: COMPARISONS[name](column, _needs(value))


registry |= {
    "eq": _equal,
    "ne": _unequal,
    "in": lambda c, _, v: c.isin(*v),
    "nin": lambda c, _, v: ~c.isin(*v),
    "is_null": lambda c, *_: c.isNull(),
    "is_not_null": lambda c, *_: c.isNotNull(),
    "present": _filled,
    "blank": _blank,
    "true": lambda c, *_: c.eqNullSafe(F.lit(True)),
    "false": lambda c, *_: c.eqNullSafe(F.lit(False)),
    "not_eq_all": _each(_unequal, fold_all),
    "gt": _compare("gt"),
    "lt": _compare("lt"),
    "gte": _compare("gteq"),
    "lte": _compare("lteq"),
    "cont": _like("%v%"),
    "starts_with": _like("v%"),
    "ends_with": _like("%v"),
    "matches": _like("v"),
    "does_not_match": _like("v", negate=True),
}
for _name in COMPARISONS:
    registry[f"{_name}_any"] = _each(_compare(_name), fold_any)
    registry[f"{_name}_all"] = _each(_compare(_name), fold_all)
# A negated test of any of the values holds if it holds for none of them; of all, if it fails for one.
for _name, _not, _shape, _fold in (("matches", "does_not_match", "v", False), ("start", "not_start", "v%", False), ("end", "not_end", "%v", False), ("i_cont", "not_i_cont", "%v%", True)):
    _yes, _no = _like(_shape, fold_case=_fold), _like(_shape, fold_case=_fold, negate=True)
    registry |= {_name: _yes, f"{_name}_any": _each(_yes, fold_any), f"{_name}_all": _each(_yes, fold_all)}
    registry |= {_not: _no, f"{_not}_any": _each(_no, fold_all), f"{_not}_all": _each(_no, fold_any)}


class Predicate(ABC):
    """A predicate as a class: subclasses with a ``name`` are registered under it, as by ``predicate``.

    The value comes in the column's type, as far as it can be one."""

    name: str = ""

    def __init_subclass__(cls) -> None:
        super().__init_subclass__()
        if cls.name:
            registry[cls.name] = lambda column, kind, value: cls().apply(column, value)

    @abstractmethod
    def apply(self, column: Column, value: Any) -> Column | None:
        """The condition; None: there is none."""


#: Operators whose classes have longer names than the operator itself.
LONGER = {"eq": "equal", "ne": "not_equal", "gt": "greater_than", "lt": "less_than", "gte": "greater_than_or_equal", "lte": "less_than_or_equal", "cont": "contains", "nin": "not_in"}


def _built_in(name: str, test: Test) -> type[Predicate]:
    """A class for a predicate that is there already, which stays as it is."""

    def apply(self: Predicate, column: Column, value: Any, kind: DataType = StringType()) -> Column | None:  # noqa: B008 - types hold no state
        return test(column, kind, value)

    made = type("".join(x.capitalize() for x in LONGER.get(name, name).split("_")) + "Predicate", (Predicate,), {"apply": apply, "__doc__": f"The operator {name}.", "__module__": __name__})
    made.name = name
    return made


#: EqualPredicate, ..., NotIContAllPredicate: a class for each of the operators above.
CLASSES: dict[str, type[Predicate]] = {c.__name__: c for c in (_built_in(n, t) for n, t in list(registry.items()))}
