"""Finished records as a stored table, so that a lookup reads what it returns and little else.

    records   split=/block=     ordered by ordinal, `ROWS` ordinals to a block, a block in one file
    listed    split=/db_part=   what lists show, ordered by database and ordinal
    postings  split=/gram_part= for each piece of three letters and block the ordinals in the block that have it, in lists

Ordinals are given once, when the table is written. Partition folders and the statistics of sorted files do the rest: a
lookup's plan has the folder in its PartitionFilters and the ordinal or database in its PushedFilters.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions.text import contains_term, filled
from schemaloom.operators.records import dense_ordinal
from schemaloom.shipping import ship

#: Ordinals in a block; rows of a list's folder, on average; letters in a piece.
ROWS, GRAM = 1 << 16, 3
#: Characters whose pieces are sorted at once, and blocks whose lists of one piece come to one task.
LETTERS, BLOCKS = 1 << 21, 64
SPLITS = ("train", "dev")
LISTED = ["idx", "db_id", "question_en", "question_ar", "SQL"]
SEARCHED = ["question_en", "SQL"]


def _text(df_columns: list[str] = SEARCHED) -> Column:
    return F.lower(F.concat_ws(" ", *[filled(F.col(c)) for c in df_columns]))


def grams(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces of three letters, the numbers of the texts that have them, rising for each piece, and where each piece's end.

    Characters are numbered, a piece and its text are one integer, and these are sorted: no row per piece and text is made.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    there = np.zeros(int(points.max(initial=0)) + 1, bool)
    there[points] = True
    letters = np.flatnonzero(there).astype("<u4")
    size, n = len(letters), len(texts)
    text = np.repeat(np.arange(n), np.fromiter(map(len, texts), np.int64, n))
    at = np.flatnonzero(text[:-2] == text[2:])
    if not len(at):
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    if size ** GRAM * n >= 1 << 63:
        raise OverflowError
    kinds = (np.cumsum(there, dtype=np.int64) - 1)[points]
    coded = ((kinds[at] * size + kinds[at + 1]) * size + kinds[at + 2]) * n + text[at]
    coded.sort()  # np.unique hashes integers first, which takes many times as long
    coded = coded[np.append(True, coded[1:] != coded[:-1])]
    piece = coded // n
    number = coded - piece * n
    ends = np.append(np.flatnonzero(np.diff(piece)) + 1, len(piece))
    piece = piece[ends - 1]
    joined = letters[np.stack([piece // size ** 2, piece // size % size, piece % size], 1)].tobytes().decode("utf-32-le", "surrogatepass")
    return [joined[i:i + GRAM] for i in range(0, len(joined), GRAM)], number, ends


def _lists(split: str | None, block: int, offsets: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
    """Postings of rows of one block, in order of their offsets."""
    try:
        found, number, ends = grams(texts)
    except OverflowError:  # very many different characters: in halves
        half = len(texts) // 2
        yield from _lists(split, block, offsets[:half], texts[:half])
        yield from _lists(split, block, offsets[half:], texts[half:])
        return
    at = np.asarray(offsets, np.int32)[number]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(at))
    whole = pa.RecordBatch.from_arrays([pa.array([split] * len(found), pa.string()), pa.array(np.full(len(found), block, np.int32)), pa.array(found, pa.string()),
                                        pa.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) for g in found], pa.int64()), lists],
                                       ["split", "block", "gram", "crc", "at"])
    for start in range(0, len(found), 10_000):
        yield whole.slice(start, 10_000)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of (split, block, at, text): lists for runs of rows of one block with `LETTERS` characters, or a piece of a longer text."""
    run, offsets, texts, letters = None, [], [], 0
    for b in batches:
        for split, block, at, raw in zip(*(c.to_pylist() for c in b.columns)):
            text = raw.decode("utf-8", "replace")
            if texts and (run != (split, block) or letters + len(text) > LETTERS):
                yield from _lists(*run, offsets, texts)
                offsets, texts, letters = [], [], 0
            run = split, block
            for start in range(0, max(1, len(text) - GRAM + 1), LETTERS):
                if texts and start:
                    yield from _lists(*run, offsets, texts)
                    offsets, texts, letters = [], [], 0
                offsets.append(at)
                texts.append(text[start:start + LETTERS + GRAM - 1])
                letters += len(texts[-1])
    if texts:
        yield from _lists(*run, offsets, texts)


def write_store(records: DataFrame, folder: str, key: str, rows: int = ROWS) -> RecordStore:
    """Writes `records` (split, db_id, `LISTED` without idx, and whatever else), numbered by `key` within each split."""
    spark = records.sparkSession
    block = F.floor(F.col("idx") / rows).cast("int")
    numbered = dense_ordinal(records, key, ["split"]).withColumn("block", block)
    # a block is one task's and one file's
    (numbered.repartition("split", "block").sortWithinPartitions("split", "block", "idx")
     .write.partitionBy("split", "block").parquet(f"{folder}/records"))
    store = RecordStore(spark, folder, rows, max(1, -(-_stored(spark, f"{folder}/records", numbered).count() // rows)), numbered.schema.json())
    source = store.records()
    # ranges, not hashes, of the database: one with very many records is dealt out by ordinal
    listed = source.select("split", "db_id", *[filled(F.col(c)).alias(c) for c in LISTED[2:]], "idx", store.part_of(F.col("db_id")).alias("db_part"))
    order = ["split", "db_part", "db_id", "idx"]
    listed.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("split", "db_part").parquet(f"{folder}/listed")
    ship(spark)
    offset = (F.col("idx") - F.col("block").cast("long") * rows).cast("int")
    # from the ranges of ordinals, which are finer than the blocks' files
    texts = numbered.select("split", "block", offset.alias("at"), _text().cast("binary").alias("text"))
    postings = (texts.mapInArrow(_posted, "split string, block int, gram string, crc long, at array<int>")
                .withColumn("gram_part", (F.col("crc") % store.parts).cast("int")).drop("crc"))
    (postings.repartition("split", "gram_part", F.floor(F.col("block") / BLOCKS)).sortWithinPartitions("split", "gram_part", "gram", "block")
     .write.partitionBy("split", "gram_part").parquet(f"{folder}/postings"))
    about = json.dumps({"rows": rows, "parts": store.parts, "schema": json.loads(store.schema)})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{folder}/about")
    return store


def open_store(spark: SparkSession, folder: str) -> RecordStore:
    about = json.loads(spark.read.text(f"{folder}/about").first()[0])
    return RecordStore(spark, folder, about["rows"], about["parts"], json.dumps(about["schema"]))


def _stored(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(folder)


@dataclass(frozen=True)
class RecordStore:
    """A table written by `write_store`. A split that is not named is the first of `SPLITS`; names are taken in lower case."""
    spark: SparkSession
    folder: str
    rows: int
    parts: int
    schema: str  # of `records`, as JSON

    def part_of(self, db_id: Column) -> Column:
        return F.pmod(F.xxhash64(db_id), F.lit(self.parts)).cast("int")

    def records(self) -> DataFrame:
        from pyspark.sql.types import StructType
        return self.spark.read.schema(StructType.fromJson(json.loads(self.schema))).parquet(f"{self.folder}/records")

    def _split(self, split: str | None) -> Column:
        return F.col("split") == (split or SPLITS[0]).lower()

    def _listed(self) -> DataFrame:
        kinds = {f.name: f.dataType.simpleString() for f in self.records().schema}
        schema = ", ".join(f"`{c}` {'string' if c in LISTED[2:] else kinds[c]}" for c in (*LISTED, "split"))
        return self.spark.read.schema(f"{schema}, db_part int").parquet(f"{self.folder}/listed")

    def db_counts(self) -> DataFrame:
        """(split, db_id, count): how many records each database has."""
        return (self._listed().groupBy("split", F.coalesce("db_id", F.lit("")).alias("db_id")).agg(F.count("*").alias("count"))
                .orderBy("split", "db_id"))

    def list_records(self, split: str | None = None, db_id: str | None = None) -> DataFrame:
        """Rows of a split, of one database if named: one folder and the pages of it that have the database."""
        rows = self._listed().where(self._split(split))
        if db_id:
            rows = rows.where((F.col("db_part") == self.part_of(F.lit(db_id))) & (F.col("db_id") == db_id))
        return rows.select(*LISTED)

    def record_at(self, idx: int, split: str | None = None) -> DataFrame:
        """The record at an ordinal of a split, from its block's file; out of range gives no row."""
        here = self._split(split) & (F.col("block") == idx // self.rows) & (F.col("idx") == idx)
        return self.records().where(here).drop("block")

    def candidates(self, term: str, split: str | None = None) -> DataFrame:
        """(block, idx) of the records that have all pieces of a term of three letters or more."""
        needle = term.strip().lower()
        wanted = sorted({needle[i:i + GRAM] for i in range(len(needle) - GRAM + 1)})
        parts = sorted({zlib.crc32(g.encode()) % self.parts for g in wanted})
        postings = (self.spark.read.schema("gram string, block int, at array<int>, split string, gram_part int")
                    .parquet(f"{self.folder}/postings"))
        mine = postings.where(self._split(split) & F.col("gram_part").isin(parts) & F.col("gram").isin(wanted))
        # a piece's lists of a block as one, at most `rows` numbers; a text cut into several comes more than once
        mine = mine.groupBy("block", "gram").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
        # the shortest list first
        lists = F.array_sort(F.collect_list("at"), lambda a, b: F.size(a) - F.size(b))
        both = F.aggregate(F.slice("lists", 2, len(wanted)), F.col("lists")[0], F.array_intersect) if len(wanted) > 1 else F.col("lists")[0]
        return (mine.groupBy("block").agg(lists.alias("lists")).where(F.size("lists") == len(wanted))
                .select("block", F.explode(both).alias("at"))
                .select("block", (F.col("block").cast("long") * self.rows + F.col("at")).alias("idx")))

    def search(self, term: str, split: str | None = None, db_id: str | None = None) -> DataFrame:
        """Listed rows whose English question or SQL contains the term in any case.

        Candidates come from the postings, and only blocks that have one are read; each is verified on its text. A term of
        fewer than three letters has no piece to look up and is found by reading the split; a blank one matches all.
        """
        if len(term.strip().lower()) < GRAM:
            return self.list_records(split, db_id).where(contains_term(term, *map(F.col, SEARCHED)))
        found = self.candidates(term, split)
        blocks = [r["block"] for r in found.select("block").distinct().collect()]  # as many as the split has files
        rows = self.records().where(self._split(split) & F.col("block").isin(blocks)).join(found, ["block", "idx"], "left_semi")
        if db_id:
            rows = rows.where(F.col("db_id") == db_id)
        return (rows.where(contains_term(term, *map(F.col, SEARCHED)))
                .select("idx", "db_id", *[filled(F.col(c)).alias(c) for c in LISTED[2:]]))
