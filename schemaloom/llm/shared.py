"""What several operators need: the shared folder, row keys, and lookups that survive hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy if it has at least this share of the rows, so there are at most 1 / share heavy keys.
HEAVY = 1000
#: Words are runs of anything but these six characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def workspace(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only a local session may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame, *partitions: str) -> DataFrame:
    """`df` written to the shared folder and read back, so that a lost executor costs no more than a reread."""
    folder = workspace(df.sparkSession)
    (df.write.partitionBy(*partitions) if partitions else df.write).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def row_key(doc_id: str, text: str) -> tuple[Column, Column]:
    """Two columns that tell rows apart as far as their results differ: rows with equal id and text have equal results."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)), F.xxhash64(F.col(text))


def quoted(names: list[str]) -> list[str]:
    """Column names for `select`, whatever characters are in them."""
    return [f"`{n.replace('`', '``')}`" for n in names]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, how: str = "left") -> DataFrame:
    """`rows` joined (left or inner) to `table`, which has one row per key and in `count` the number of `rows` with it.

    Keys with at least total / HEAVY rows are at most HEAVY, whatever the size of the data: those are broadcast. Of the
    rest none has more than that share, so their join is dealt out evenly. `count` is dropped.
    """
    heavy = table.where(F.col(count) * HEAVY >= total).drop(count)
    light = table.where(F.col(count) * HEAVY < total).drop(count)
    hot = rows.join(F.broadcast(heavy), keys, "inner")
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    return hot.unionByName(rest.select(*hot.columns))


#: What an operator keeps in a worker process from one task to the next, and what it was made from: one object at a time.
_KEPT: list = []


def kept(shared, make):
    """make(shared.value), made once per worker process and broadcast. What another operator kept there before is let go."""
    value = shared.value  # one object per process and broadcast
    if not _KEPT or _KEPT[0] is not value or _KEPT[1] is not make:
        _KEPT.clear()
        _KEPT[:] = [value, make, make(value)]
    return _KEPT[2]


def let_go() -> None:
    """For tasks that need nothing kept: frees what earlier stages left in this worker process."""
    _KEPT.clear()
