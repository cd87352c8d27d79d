"""How lookups are joined: the looked-up side stays where it is, and keys that very many rows share do not share a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has at least this share of the rows, so there are at most 1 / share hot keys; and so many rows at least,
#: below which any task bears it.
HOT_SHARE, HOT_ROWS = 1 / 1000, 10_000


def lookup_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join `rows` to a lookup with at most one row per key."""
    return rows.join(table, on, how)


def hot_keys(rows: DataFrame, on: list[str], least: int = HOT_ROWS) -> DataFrame | None:
    """The hot keys of `rows`, counted; None if there is none."""
    total = rows.count()
    if total < least:
        return None
    counts = rows.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") >= max(least, total * HOT_SHARE))
    keys = [k for r in counts.collect() if None not in (k := tuple(r)[:-1])]  # 1 / HOT_SHARE at most
    return rows.sparkSession.createDataFrame(keys, counts.select(*on).schema) if keys else None


#: Rows in a task that sorts, groups or joins them.
ROWS = 400_000


def dealt(df: DataFrame, on: list[str], total: int) -> DataFrame:
    """`df` dealt out by key to as many tasks as `total` rows need, whatever the session's number of partitions.

    The tables of a join that get the same keys and total meet without another shuffle. Few rows are left to the session.
    """
    spark = df.sparkSession
    wanted = -(-total // ROWS)
    if wanted <= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions"))), *on)


def split_lookup_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left", hot: DataFrame | None = None,
                      least: int = HOT_ROWS) -> DataFrame:
    """`lookup_join` (left, inner or left_semi) for rows of which very many may share one key. `table` may have a few rows per key.

    Hot keys, 1000 at most, are counted first (or given as `hot`); what the table has on them is broadcast. The rest is joined
    by key, and a table that is stored by these keys is not shuffled for it. Null keys find nothing.
    """
    hot = hot_keys(rows, on, least) if hot is None else hot
    if hot is None:
        return lookup_join(rows, table, on, how)
    few = F.broadcast(hot)
    columns = lookup_join(rows, table, on, how).columns
    mine = lookup_join(rows.join(few, on, "left_semi"), F.broadcast(table.join(few, on, "left_semi")), on, how)
    rest = lookup_join(rows.join(few, on, "left_anti"), table, on, how)
    return mine.select(*columns).unionByName(rest.select(*columns))


#: Texts in a task that reads SQL. Such texts pack so well that a split by bytes may have millions.
TEXTS = 50_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows over all cores, for work that is heavy per row; tables with enough splits are left alone.

    rows: so many in a task at most, for a table whose rows are counted by its files alone.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        wanted = max(wanted, -(-df.count() // rows))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
