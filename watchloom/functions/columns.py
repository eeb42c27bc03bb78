"""Small Column builders the other modules share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def case_of(key: Column | str, mapping: Mapping[str, object], default: object) -> Column:
    """CASE over literal keys."""
    key = as_column(key)
    items = iter(mapping.items())
    first, value = next(items)
    expr = F.when(key == first, F.lit(value))
    for k, v in items:
        expr = expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def compact(*options: Column) -> Column:
    """Array of the options that are not null, for ``explode``."""
    return F.filter(F.array(*options), lambda x: x.isNotNull())


def explode_once(df: DataFrame, keep: Sequence[str], values: Column, name: str) -> DataFrame:
    """One row per non-null element of an array that is costly to compute.

    A plain ``explode`` makes the optimizer test the array's size first, which
    evaluates it twice; the outer form with a filter behind it does not.
    """
    return df.select(*keep, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


def held(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that are computed once per row however often they are used.

    Projections are merged and would repeat the expression at each use; the
    output of a generator is kept.
    """
    row = F.struct(*[v.alias(k) for k, v in values.items()])
    return df.select("*", F.explode_outer(F.array(row)).alias("_held")).select(*df.columns, "_held.*")


def div_floor(value: Column, width: Column | int) -> Column:
    """Floor division of longs, also right below zero."""
    width = F.lit(width) if isinstance(width, int) else width
    return ((value - F.pmod(value, width)) / width).cast("long")


def fixed(value: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals and no grouping."""
    return F.format_string(f"%.{digits}f", value.cast("double"))
