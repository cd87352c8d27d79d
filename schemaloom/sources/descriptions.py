"""Description CSV files: `<root>/<database folder>/database_description/<table>.csv`."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions.text import norm_key
from schemaloom.operators.joins import lookup_join
from schemaloom.shipping import ship
from schemaloom.sources.encodings import read_texts

ROW_SCHEMA = ("path string, row_no int, original_column_name string, column_name string, "
              "column_description string, error string")

#: Description rows after which a frame is handed over.
FRAME = 1000


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """CSV text to rows by header name, file by file. Cells may be of any length. A file that cannot be read becomes one
    row with `error` set. Small files share a frame of `FRAME` rows or some more."""
    csv.field_size_limit(sys.maxsize)
    names = ["path", "row_no", "original_column_name", "column_name", "column_description", "error"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        out["row_no"] = out["row_no"].astype("Int32")
        return out

    for batch in batches:
        found = []
        for path, text in zip(batch["path"], batch["text"]):
            try:
                rows = [(path, i, r.get("original_column_name") or r.get("original"), r.get("column_name"),
                         r.get("column_description") or r.get("description"), None)
                        for i, r in enumerate(csv.DictReader(io.StringIO(text, newline="")))]
            except csv.Error as e:
                rows = [(path, None, None, None, None, str(e))]
            found += rows
            if len(found) >= FRAME:
                yield frame(found)
                found = []
        if found:
            yield frame(found)


def parse_files(texts: DataFrame) -> DataFrame:
    """(path, text) files to description rows; Spark spreads the files, each is parsed in its own task."""
    ship(texts.sparkSession)
    return texts.select("path", "text").mapInPandas(_parse, ROW_SCHEMA)


def _file_system(spark: SparkSession, folder: str):
    """The store that has the folder, and the folder's path in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def read_description_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """All description rows below the roots, with `root_ord`, `folder` and `file` (name without extension). A root that is not there
    has none."""
    out = spark.createDataFrame([], f"{ROW_SCHEMA}, root_ord int")
    for i, root in enumerate(roots):
        fs, path = _file_system(spark, root)
        if fs.exists(path):
            out = out.unionByName(parse_files(read_texts(spark, root, "*.csv")).withColumn("root_ord", F.lit(i)))
    inside = r"([^/]+)/database_description/([^/]+)\.csv$"
    name = lambda g: F.url_decode(F.replace(F.regexp_extract("path", inside, g), F.lit("+"), F.lit("%2B")))
    return (out.filter(F.regexp_like("path", F.lit(inside)))
            .select("root_ord", name(1).alias("folder"), name(2).alias("file"), "row_no", "original_column_name",
                    "column_name", "column_description", "error"))


def bad_files(rows: DataFrame) -> DataFrame:
    """(folder, file, error) of the files that were passed over."""
    return rows.filter("error is not null").select("root_ord", "folder", "file", "error")


def list_folders(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(root_ord, folder): the folders right below each root, from its listing; a root that is not there has none.

    Names only, nothing is opened. A folder without description files is listed too, and so hides one under a later root.
    """
    found = []
    for i, root in enumerate(roots):
        fs, path = _file_system(spark, root)
        if fs.exists(path):
            found += [(i, s.getPath().getName()) for s in fs.listStatus(path) if s.isDirectory()]
    return spark.createDataFrame(found, "root_ord int, folder string")


def resolve_folders(dbs: DataFrame, folders: DataFrame) -> DataFrame:
    """(db_id, root_ord, folder): where each database lies.

    Roots are tried in order; within a root the exact name beats one that is equal after `norm_key`, and of
    several equal ones the first by name is taken. Databases without a folder are left out.
    """
    # One row per name and one per key, however many folders share a key.
    exact = folders.groupBy(F.col("folder").alias("db_id")).agg(F.min("root_ord").alias("exact_root"))
    alike = (folders.groupBy(norm_key(F.col("folder")).alias("name_key"))
             .agg(F.min(F.struct("root_ord", "folder")).alias("alike")))
    ids = dbs.select("db_id").distinct().withColumn("name_key", norm_key(F.col("db_id")))
    found = lookup_join(ids, exact, ["db_id"])
    found = lookup_join(found, alike, ["name_key"])
    is_exact = F.col("exact_root").isNotNull() & (F.col("exact_root") <= F.col("alike.root_ord"))
    return (found.select("db_id", F.when(is_exact, F.col("exact_root")).otherwise(F.col("alike.root_ord"))
                         .alias("root_ord"),
                         F.when(is_exact, F.col("db_id")).otherwise(F.col("alike.folder")).alias("folder"))
            .filter("folder is not null"))


def descriptions_by_db(dbs: DataFrame, rows: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Description rows under the `db_id` whose folder holds them, bad files passed over.

    folders: all folders below the roots (`list_folders`); None for those that have rows.
    """
    good = rows.filter("error is null").drop("error")
    homes = resolve_folders(dbs, rows.select("root_ord", "folder").distinct() if folders is None else folders)
    return good.join(homes, ["root_ord", "folder"]).drop("root_ord", "folder")
