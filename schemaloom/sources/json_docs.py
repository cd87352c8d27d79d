"""JSON documents whose top level is an array, read in array order."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.operators.catalog import ENTRY_SCHEMA
from schemaloom.sources.encodings import read_texts

QUESTION_SCHEMA = ("question_id long, db_id string, question string, question_en string, question_ar string, "
                   "evidence string, evidence_en string, evidence_ar string, SQL string, difficulty string")


def array_items(text: Column, strict: bool = False) -> Column:
    """The items of a JSON array, each as JSON text. Text that is no whole array gives null, or an error if `strict`."""
    items = F.when(F.regexp_like(text, F.lit(r"^\s*\[")), F.from_json(text, T.ArrayType(T.StringType())))
    return F.coalesce(items, F.raise_error(F.lit("expected a JSON array"))) if strict else items


def explode_items(docs: DataFrame, schema: str, text: str = "text", strict: bool = False, rest: str | None = None,
                  but: list[str] | None = None) -> DataFrame:
    """Rows of the objects in the arrays in `text` with their 0-based `pos`; the other columns are kept.

    Items are read one by one: one that is no object, or whose fields do not fit, takes nothing else with it. If `rest` is
    given, that map column has all fields as they are, whatever their types, without those in `but` (None: those of the schema).
    """
    others = [c for c in docs.columns if c != text]
    items = docs.select(*others, F.posexplode(array_items(F.col(text), strict)).alias("pos", "item"))
    known = T.StructType.fromDDL(schema)
    left = known.names if but is None else but
    unknown = F.map_filter(F.from_json("item", "map<string,variant>"), lambda name, _: ~name.isin(left))
    return (items.filter(F.regexp_like("item", F.lit(r"^\s*\{")))
            .select(*others, "pos", F.from_json("item", known).alias("read"), *([unknown.alias(rest)] if rest else []))
            .select(*others, "pos", "read.*", *([rest] if rest else [])))


def read_array(spark: SparkSession, paths: str | list[str], schema: str, strict: bool = False, rest: str | None = None,
               but: list[str] | None = None) -> DataFrame:
    """Array documents as rows with `path` and `pos`. A document is one task; ingest large ones once."""
    return explode_items(read_texts(spark, paths), schema, strict=strict, rest=rest, but=but)


def read_array_or_empty(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Like `read_array`, but a missing path or an unreadable document gives no rows."""
    try:
        return read_array(spark, paths, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"path string, pos int, {schema}")


def read_entries(spark: SparkSession, paths: str | list[str], schema: str = ENTRY_SCHEMA, rest: str | None = None) -> DataFrame:
    """Schema entries with `pos`. A foreign key that is no pair of numbers does not affect the others.

    `rest` has each entry as it stands in the file, but for the descriptions that enriching attaches.
    """
    loose = schema.replace("foreign_keys array<array<int>>", "foreign_keys array<string>")
    pair = lambda p: F.transform(F.from_json(p, "array<string>"), lambda end: end.try_cast("int"))
    entries = read_array(spark, paths, loose, rest=rest, but=["column_descriptions", "foreign_key_descriptions"])
    return entries.drop("path").withColumn("foreign_keys", F.transform("foreign_keys", pair))


def read_questions(spark: SparkSession, paths: str | list[str], schema: str = QUESTION_SCHEMA) -> DataFrame:
    """Question records with `pos`; a missing file gives no rows."""
    return read_array_or_empty(spark, paths, schema).drop("path")
