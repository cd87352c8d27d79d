"""The operators as registered queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import alignment, clustering, exact_dedup, language_id, line_dedup, mixing, quality, sentencepiece_codec, simhash, substring_dedup, token_files, url_filter, warc

#: The mixture: weights of the nodes by level; nodes that are not named weigh 1.
WEIGHTS = {"domain": {"web": 5, "books": 3, "news": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_of(source: Column) -> Column:
    """The domain a source belongs to, by the number in its name."""
    n = F.try_to_number(F.regexp_extract(source, r"(\d{1,9})$", 1), F.lit("999999999")) % 3
    return F.when(n == 0, "web").when(n == 1, "news").when(n == 2, "books")


def op1_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, d, "documents"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"),
                      F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    out = quality.quality_rules(table(spark, d, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      F.round("p_good", 6).alias("p_good"))


def op3_warc_convert(spark: SparkSession, d: str) -> DataFrame:
    out = warc.archive_round_trip(table(spark, d, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op4_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, d, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.url_filter(table(spark, d, "pages"), table(spark, d, "labels")).select("page_id", "host", "path", "rule", "verdict")


def op6_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = language_id.train(docs.where(~language_id.in_fold(F.col("doc_id"))))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.in_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op7_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    coded = sentencepiece_codec.round_trip(docs, sentencepiece_codec.read_vocabulary())
    return coded.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op8_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, d, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.when(F.col("left").isNull(), F.col("words_sha256"))
                      .otherwise(F.sha2(F.col("left"), 256)).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, d: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, d, "documents"), domain_of(F.col("source")), F.col("lang"), F.col("source"),
                             mixing.n_words(F.col("text")), WEIGHTS)
    return out.drop("text_hash")


def op10_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """History: the older half of the ids' range."""
    docs = table(spark, d, "documents")
    ids = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    history = F.col("doc_id") <= F.lit(((ids["a"] or 0) + (ids["b"] or 0) - 1) // 2)  # doc_id * 2 < a + b, for ids of any size
    return exact_dedup.exact_dedup(docs, history)


def op11_token_files(spark: SparkSession, d: str) -> DataFrame:
    with open(token_files.vocabulary_file("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    return token_files.round_trip(table(spark, d, "documents"), spec)


def op12_alignment(spark: SparkSession, d: str) -> DataFrame:
    spec = alignment.read_spec(token_files.vocabulary_file("byte_bpe_50k.json"), token_files.vocabulary_file("piece_bpe_32k.model"))
    return alignment.alignment(table(spark, d, "documents"), spec)


def op13_clustering(spark: SparkSession, d: str) -> DataFrame:
    return clustering.cluster(table(spark, d, "embeddings"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # noqa: F401  part of this subpackage: without it none of the queries is offered
    return {f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_warc_convert, op4_simhash, op5_url_filter, op6_language_id,
                                    op7_sentencepiece, op8_substring_dedup, op9_mixing, op10_exact_dedup, op11_token_files,
                                    op12_alignment, op13_clustering, pipeline)}
