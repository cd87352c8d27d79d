"""Bilingual question records: normalising, numbering, splitting for translators and merging back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.functions.text import filled
from schemaloom.sources.sinks import shared_folder, staged

# Fixed output order of the known fields.
LEADING = ["question_id", "db_id"]
PAIRS = ["question_en", "question_ar", "evidence_en", "evidence_ar"]
TRAILING = ["SQL", "difficulty"]


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def bilingual(df: DataFrame) -> DataFrame:
    """Records with English and Arabic question and evidence, known fields first.

    A legacy `question` or `evidence` wins over the `_en` field; what is missing becomes ''.
    """
    pairs = [filled(F.coalesce(_column(df, "question"), _column(df, "question_en"))).alias("question_en"),
             filled(_column(df, "question_ar")).alias("question_ar"),
             filled(F.coalesce(_column(df, "evidence"), _column(df, "evidence_en"))).alias("evidence_en"),
             filled(_column(df, "evidence_ar")).alias("evidence_ar")]
    known = {*LEADING, *PAIRS, *TRAILING, "question", "evidence"}
    present = lambda names: [c for c in names if c in df.columns]
    return df.select(*present(LEADING), *pairs, *present(TRAILING), *[c for c in df.columns if c not in known])


def is_changed(df: DataFrame) -> Column:
    """Would `bilingual` change the record? Only the order of fields does not count."""
    legacy = [_column(df, c).isNotNull() for c in ("question", "evidence")]
    missing = [_column(df, c).isNull() for c in PAIRS]
    return reduce(lambda a, b: a | b, [*legacy, *missing])


def change_report(df: DataFrame) -> DataFrame:
    """One row: records, changed records, and how many lack or carry each field concerned."""
    return df.agg(
        F.count("*").alias("records"), F.count_if(is_changed(df)).alias("changed"),
        *[F.count_if(_column(df, c).isNotNull()).alias(f"legacy_{c}") for c in ("question", "evidence")],
        *[F.count_if(_column(df, c).isNull()).alias(f"missing_{c}") for c in PAIRS])


def union_files(*dfs: DataFrame) -> DataFrame:
    """Question files one after the other; `file_ord` keeps their order. Fields a file lacks are null."""
    tagged = [df.withColumn("file_ord", F.lit(i)) for i, df in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def split_contiguous(df: DataFrame, parts: int, pos: str = "idx") -> DataFrame:
    """`df` with `part` 1..parts: contiguous chunks of a dense 0-based position, the first ones one longer.

    Arithmetic on the position; the only other work is the row count. Fewer rows than parts leave the last
    parts without rows.
    """
    if parts <= 1:
        return df.withColumn("part", F.lit(1))
    n = df.agg(F.count("*").alias("n")).scalar()
    p, k = F.col(pos).cast("long"), F.lit(parts)
    sized = df.withColumn("_base", F.call_function("div", n, k)).withColumn("_extra", n % k)
    base, extra = F.col("_base"), F.col("_extra")
    long_rows = extra * (base + 1)
    # A base of zero means every row is in a long chunk, so the second branch never divides by it.
    part = F.when(p < long_rows, F.call_function("div", p, base + 1)).otherwise(
        extra + F.call_function("div", p - long_rows, F.greatest(base, F.lit(1).cast("long"))))
    return sized.withColumn("part", (part + 1).cast("int")).drop("_base", "_extra")


#: `monotonically_increasing_id` has the partition above this many bits, and below them the row's place in it.
_PLACE_BITS = 33


def range_placed(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """`df` in ranges of `order`, sorted inside each, with `_place`: the range above 33 bits, the row's place in it below.

    Written to the shared folder, so that counting the ranges and numbering the rows see the same ones. How many ranges there
    are follows the data (adaptive execution merges small ones) unless `partitions` says so.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = ranged.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    return staged(placed, shared_folder(df.sparkSession))


def dense_ordinal(df: DataFrame, key: str, by: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """`df` with `idx`: 0, 1, 2, ... in the order of a unique key, within each group of `by`.

    Rows are numbered inside ranges of (`by`, `key`) and shifted by the rows before; no window, and no task has more than a
    range. What the driver adds up is one number per range and group, so `by` is meant for a few groups, such as splits.
    """
    by = by or []
    placed = range_placed(df, [*by, key], partitions)
    part = F.shiftright("_place", _PLACE_BITS).alias("_part")
    found = placed.groupBy(*by, part).agg(F.count("*").alias("n"), F.min("_place").alias("first")).orderBy("_part", "first")
    shifts, before = [], {}
    for r in found.collect():  # one row per range and group in it
        group = tuple(r)[:len(by)]
        shifts.append((*group, r["_part"], before.get(group, 0) - r["first"]))
        before[group] = before.get(group, 0) + r["n"]
    kinds = [found.schema[c] for c in (*by, "_part")]
    table = df.sparkSession.createDataFrame(shifts, T.StructType([*kinds, T.StructField("_shift", T.LongType())]))
    same = [placed[c].eqNullSafe(table[c]) for c in by] + [F.shiftright(placed["_place"], _PLACE_BITS) == table["_part"]]
    return (placed.join(F.broadcast(table), reduce(lambda a, b: a & b, same))
            .select(*[placed[c] for c in df.columns], (placed["_place"] + table["_shift"]).alias("idx")))


def file_ordinal(df: DataFrame) -> DataFrame:
    """`df` with `idx`, from (`file_ord`, `pos`) where positions within a file are already dense."""
    shifts, before = [], 0
    for r in df.groupBy("file_ord").agg(F.count("*").alias("n")).orderBy("file_ord").collect():  # one row per file of the union
        shifts.append((r["file_ord"], before))
        before += r["n"]
    table = df.sparkSession.createDataFrame(shifts, "file_ord int, _shift long")
    return (df.join(F.broadcast(table), "file_ord").withColumn("idx", F.col("pos") + F.col("_shift"))
            .select(*df.columns, "idx"))


def merge_translations(base: DataFrame, chunks: list[DataFrame], key: str = "question_id",
                       fields: tuple[str, ...] = ("question_ar", "evidence_ar"), order: list[str] | None = None) -> DataFrame:
    """Translated fields of the chunks put into the records; an empty translation leaves the record as it is.

    If chunks repeat a key, the last chunk with a filled field wins, and within a chunk the last row by `order`, so no
    record is ever doubled.
    """
    rows = union_files(*[c.select(key, *fields, *(order or [])) for c in chunks])
    latest = rows.groupBy(key).agg(*[
        F.max_by(f, F.when(filled(F.col(f)) != "", F.struct("file_ord", *(order or []), f))).alias(f"_{f}") for f in fields])
    merged = base.join(latest, key, "left")
    put = {f: filled(F.coalesce(F.nullif(F.col(f"_{f}"), F.lit("")), F.col(f))) for f in fields}
    return merged.select(*[put[c].alias(c) if c in put else F.col(c) for c in base.columns])
