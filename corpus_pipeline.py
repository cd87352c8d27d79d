"""A corpus from documents: language ID, line dedup, SimHash near-dedup, mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import language_id, line_dedup, mixing, sentencepiece_codec, simhash
from schemaloom.llm.queries import WEIGHTS, domain_of
from schemaloom.llm.shared import quoted, staged

#: Tokens of the mixture as a part of those that are left, in per cent; nothing comes twice after deduplication.
PERCENT, EPOCHS = 80, 1


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__id": F.col("doc_id"), "__text_hash": F.xxhash64("text")})


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models accept; `lang` is left as it was. Models come from rows outside the held-out fold."""
    model = language_id.train(docs.where(~language_id.in_fold(F.col("doc_id"))))
    return language_id.kept(docs, model)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sources share; n_chars follows the text."""
    out = line_dedup.line_dedup(docs)
    changed = F.col("__n_removed") > 0
    return out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*quoted(docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the least id, one without an id if none has any. Repeated rows of it come once."""
    grouped = simhash.simhash_dedup(docs)
    # the group's document: least id, nulls last, then least text hash where an id has several texts
    order = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_hash")
    first = staged(grouped.groupBy("root").agg(F.min(order).alias("k")).select("k.doc_id", "k.text_hash"))
    mine, k = _keyed(docs), first.select(F.col("doc_id").alias("__k"), F.col("text_hash").alias("__h"))
    on = mine["__id"].eqNullSafe(k["__k"]) & (mine["__text_hash"] == k["__h"])
    return mine.join(k, on, "left_semi").dropDuplicates(["__id", "__text_hash"]).select(*quoted(docs.columns))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture."""
    leaf = {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    chosen = mixing.mix_sources(docs, **leaf, tokens=mixing.n_words(F.col("text")), weights=WEIGHTS, percent=PERCENT, max_epochs=EPOCHS)
    return mixing.mixed(docs, chosen, leaf=leaf)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as ids, with the text read back from them."""
    vocabulary = sentencepiece_codec.read_vocabulary()
    return sentencepiece_codec.round_trip(docs, vocabulary)


STAGES = [("language_id", identified), ("line_dedup", without_boilerplate), ("simhash", one_of_each), ("mixing", to_weights),
          ("sentencepiece", encoded)]
#: Language models and SimHash fingerprints are beyond SQL; tests/llm/test_pipeline.py holds all rows of run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
