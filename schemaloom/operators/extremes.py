"""Queries for the rows that reach a minimum or maximum, ties included.

The extreme itself is an uncorrelated scalar subquery: one partial aggregate, one value. No window and no sort
over the data is needed, and no key is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extreme_of(df: DataFrame, value: Column, how: str = "max") -> Column:
    """The extreme as a scalar subquery."""
    pick = {"max": F.max, "min": F.min}[how]
    return df.agg(pick(value).alias("extreme")).scalar()


def tied_extreme(df: DataFrame, value: Column, how: str = "max", scope: DataFrame | None = None,
                 scope_value: Column | None = None) -> DataFrame:
    """All rows of `df` whose value is the extreme over `scope` (default: `df` itself)."""
    within = df if scope is None else scope
    return df.filter(value == extreme_of(within, value if scope_value is None else scope_value, how))


def tied_extreme_by_key(df: DataFrame, keys: list[str], value: Column, how: str = "max", scope: DataFrame | None = None) -> DataFrame:
    """All rows of `df` whose value is the extreme of their own key's rows in `scope` (default: `df` itself).

    One partial aggregate finds the extremes of all keys, in place of a subquery for each; the way back is a semi-join on key
    and value, so that of a key with very many rows only the tied ones meet. Rows with a null key or value are none.
    """
    pick = {"max": F.max, "min": F.min}[how]
    extremes = (df if scope is None else scope).groupBy(*keys).agg(pick(value).alias("_value"))
    return df.withColumn("_value", value).join(extremes, [*keys, "_value"], "left_semi").drop("_value")


def extreme_groups(df: DataFrame, keys: list[str], how: str = "max", counted: Column | None = None) -> DataFrame:
    """Groups whose count is the largest or smallest of all: (keys, group_count)."""
    target = F.lit(1) if counted is None else counted
    counts = df.groupBy(*keys).agg(F.count(target).alias("group_count"))
    return counts.filter(F.col("group_count") == extreme_of(counts, F.col("group_count"), how))


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """a / b as a double; null where b is zero or either is null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def year_of(text: Column) -> Column:
    """Four-digit year of a date given as text or timestamp; null if it is none."""
    return F.date_format(F.try_to_timestamp(text.cast("string")), "yyyy")


def first_by(df: DataFrame, order: list[Column], n: int = 1) -> DataFrame:
    """Top n without ties; end `order` with a unique column to make the pick stable."""
    return df.orderBy(*order).limit(n)


def truthy(c: Column) -> Column:
    """A number used as a condition."""
    return F.coalesce(c != 0, F.lit(False))


def text_equals_number(text: Column, number) -> Column:
    """Text compared with a number; text that is no number never matches."""
    return F.coalesce(text.try_cast("double") == F.lit(number).cast("double"), F.lit(False))
