"""Filters that come as data: a tree of comparisons, optional criteria, and conditions chained by and/or."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARISONS = {"eq": operator.eq, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def tree(node: Mapping) -> Column:
    """``{"operator": "and" | "or", "operands": [node, ...]}`` or ``{"operator": "eq", "operands": [column, value]}``."""
    name, operands = node["operator"].lower(), node["operands"]
    if name in ("and", "or"):
        parts = [tree(n) for n in operands]
        return functools.reduce(operator.and_ if name == "and" else operator.or_, parts, F.lit(name == "and")) if not parts else functools.reduce(operator.and_ if name == "and" else operator.or_, parts)
    column, value = operands
    if name == "btwn":
        return F.col(column).between(*value)
    return COMPARISONS[name](F.col(column), F.lit(value))


def optional(criteria: Iterable[tuple[str, str, object]]) -> Column:
    """All (column, comparison, value) whose value is set; a value of None is no criterion, a list means one of."""
    test = F.lit(True)
    for column, name, value in criteria:
        if value is None or (isinstance(value, list | tuple) and not value):
            continue
        test = test & (F.col(column).isin(list(value)) if name == "in" else COMPARISONS[name](F.col(column), F.lit(value)))
    return test


def conditions(chain: list[tuple[str, bool, object, bool]]) -> Column:
    """(column, is more, limit, joined to the next by and), folded from left to right; ``>=`` if more, else ``<=``."""
    out: Column | None = None
    by_and = True
    for column, more, limit, conjunction in chain:
        test = F.col(column) >= F.lit(limit) if more else F.col(column) <= F.lit(limit)
        out = test if out is None else (out & test if by_and else out | test)
        by_and = conjunction
    return F.lit(True) if out is None else out


def scan(rows: DataFrame, criteria: Iterable[tuple[str, str, object]], by: str, most: int, *ties: str) -> DataFrame:
    """A ranked scan: rows that meet the criteria, the ``most`` with the largest ``by``, numbered from 0."""
    top = rows.where(optional(criteria)).orderBy(F.desc_nulls_last(by), *ties).limit(most)
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(by), *ties)) - 1)  # of ``most`` rows
