"""Writing results, and the shared folder for work in between."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names; only a local session may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str) -> DataFrame:
    """`df` written to the shared folder and read back: later steps start from the file, not from its inputs."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, keys: list[str], folder: str, placed: bool = False) -> DataFrame:
    """`df` stored in buckets of `keys`, one file each: joins on these keys do not shuffle it.

    A table of the session's catalog with its files below `folder`; as many buckets as the session has shuffle partitions.
    `placed`: rows of a bucket are together already, as behind a join or groups by `keys`, and are not dealt out again.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"stored_{uuid.uuid4().hex}"
    (df if placed else df.repartition(n, *keys)).write.bucketBy(n, *keys).sortBy(*keys).option("path", folder).saveAsTable(name, format="parquet")
    return spark.table(name)


_ONCE: dict[tuple, Any] = {}


def stored_once(spark: SparkSession, *key: str, write: Callable[[str], Any]) -> Any:
    """What `write` has returned for `key` after filling a folder: new in every application, shared by its queries from then on.

    The key must name all that goes into it, so that other inputs are other keys; inputs are taken not to change meanwhile.
    """
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.sql.shuffle.partitions"), *key)
    if key not in _ONCE:
        _ONCE[key] = write(shared_folder(spark))
    return _ONCE[key]


def as_json(columns: list[str], rest: str | None = None) -> Column:
    """One JSON object of the columns, nulls written out, followed by the fields in the map column `rest`."""
    known = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    if rest is None:
        return known
    more = F.to_json(rest, {"ignoreNullFields": "false"})
    return F.when(F.cardinality(F.col(rest)) > 0, F.concat(F.regexp_replace(known, r"\}$", ","), F.substring(more, 2, F.length(more)))).otherwise(known)


def write_json(df: DataFrame, path: str, rest: str | None = None) -> None:
    """JSON lines in UTF-8, nulls written out, the fields in `rest` beside the columns."""
    columns = [c for c in df.columns if c != rest]
    df.select(as_json(columns, rest).alias("value")).write.mode("overwrite").text(path)


def write_chunks(df: DataFrame, path: str, stem: str, parts: int, rest: str | None = None) -> None:
    """One folder of JSON lines per chunk, named `{stem}_part{i}of{parts}`; `df` has a `part` column.

    Chunks without rows are there too.
    """
    name = lambda i: F.concat(F.lit(f"{stem}_part"), i, F.lit(f"of{parts}"))
    columns = [c for c in df.columns if c not in ("part", rest)]
    lines = df.select(name(F.col("part")).alias("chunk"), as_json(columns, rest).alias("value"))
    lines.write.mode("overwrite").partitionBy("chunk").text(path)
    # the folders that are there, by listing
    written = df.sparkSession.read.schema("value string, chunk string").text(path).inputFiles()
    filled = {int(m[1]) for f in written if (m := re.search(rf"_part(\d+)of{parts}/[^/]*$", f))}
    nothing = df.sparkSession.createDataFrame([], "value string")
    for i in sorted(set(range(1, parts + 1)) - filled):
        nothing.write.mode("overwrite").text(f"{path}/chunk={stem}_part{i}of{parts}")


def read_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Chunks written by `write_chunks`, with `chunk` taken from the folder name."""
    return spark.read.schema(f"{schema}, chunk string").json(path)
