"""Quality rules: functions from arguments to a Column that is true where a row fails."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RULES: dict[str, Callable[..., Column]] = {}


def rule(make: Callable[..., Column]) -> Callable[..., Column]:
    """Register a rule under its name; its parameters are the arguments a ruleset may give."""
    RULES[make.__name__] = make
    return make


def columns_of(arguments: dict) -> list[str]:
    """Columns a check names."""
    named = arguments.get("columns", arguments.get("column", []))
    return [named] if isinstance(named, str) else list(named)


def argument_errors(function: str, arguments: dict) -> str | None:
    try:
        inspect.signature(RULES[function]).bind(**arguments)
    except TypeError as e:
        return str(e)
    return None


@rule
def is_not_null(column: str) -> Column:
    return F.col(column).isNull()


@rule
def is_not_empty(column: str) -> Column:
    return F.col(column).cast("string") == ""


@rule
def is_not_null_and_not_empty(column: str, trim_strings: bool = False) -> Column:
    text = F.col(column).cast("string")
    return F.col(column).isNull() | ((F.trim(text) if trim_strings else text) == "")


@rule
def is_unique(columns: list) -> Column:
    """Rows whose key occurs more than once in the batch; a key with a null in it is never a duplicate."""
    names = [columns] if isinstance(columns, str) else list(columns)
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull()
    return whole & (F.count(F.lit(1)).over(W.partitionBy(*names)) > 1)


@rule
def is_in_list(column: str, allowed: list) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).isin(list(allowed))


@rule
def is_in_range(column: str, min_limit=None, max_limit=None) -> Column:
    bad = F.lit(False)
    if min_limit is not None:
        bad = bad | (F.col(column) < F.lit(min_limit))
    if max_limit is not None:
        bad = bad | (F.col(column) > F.lit(max_limit))
    return bad


@rule
def is_not_less_than(column: str, limit) -> Column:
    return F.col(column) < F.lit(limit)


@rule
def is_not_greater_than(column: str, limit) -> Column:
    return F.col(column) > F.lit(limit)


@rule
def regex_match(column: str, regex: str, negate: bool = False) -> Column:
    hit = F.col(column).rlike(regex)
    return hit if negate else ~hit


@rule
def is_valid_date(column: str, date_format: str | None = None) -> Column:
    parsed = F.try_to_date(F.col(column), date_format) if date_format else F.col(column).try_cast("date")
    return F.col(column).isNotNull() & parsed.isNull()


@rule
def is_valid_timestamp(column: str, timestamp_format: str | None = None) -> Column:
    parsed = F.try_to_timestamp(F.col(column), F.lit(timestamp_format)) if timestamp_format else F.col(column).try_cast("timestamp")
    return F.col(column).isNotNull() & parsed.isNull()


@rule
def sql_expression(expression: str) -> Column:
    """Rows for which the expression is false."""
    return ~F.expr(expression)
