"""The three jobs end to end, from files to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators import catalog as cat
from schemaloom.operators import enrich, graph, records, refs
from schemaloom.sources import descriptions, json_docs, sinks


#: The column with the fields of an entry or a record that are written back as they were.
REST = "_rest"


def description_rows(spark: SparkSession, dbs: DataFrame, roots: list[str]) -> DataFrame:
    """The description rows of the databases in `dbs` (db_id), from the folders below the roots."""
    if not roots:
        return spark.createDataFrame([], "file string, row_no int, original_column_name string, column_name string, column_description string, db_id string")
    return descriptions.descriptions_by_db(dbs, descriptions.read_description_files(spark, roots), descriptions.list_folders(spark, roots))


def load_catalog(spark: SparkSession, entries_path: str, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """Schema entries, the last of each database, as they are also in `REST`, and their description rows."""
    entries = cat.latest_entries(cat.named_entries(json_docs.read_entries(spark, entries_path, rest=REST)), "pos")
    return entries, description_rows(spark, entries, roots)


def enrich_schemas(spark: SparkSession, entries_path: str, roots: list[str], out: str) -> DataFrame:
    """Write the entries with descriptions attached and all other fields as they were; returns the counts.

    Entries go by their place in the file: repeated entries of a database are each enriched and written, and entries without
    a database id are written as they were, all in the order of the file.
    """
    keep = lambda df: sinks.staged(df, sinks.shared_folder(spark))
    entries = keep(json_docs.read_entries(spark, entries_path, rest=REST))
    named = cat.named_entries(entries)
    places = named.select("db_id", F.col("pos").cast("string").alias("place"))
    # from here on an entry's place stands for its database
    rows = description_rows(spark, named, roots).join(places, "db_id").drop("db_id").withColumnRenamed("place", "db_id")
    placed = named.withColumn("db_id", F.col("pos").cast("string"))
    described = keep(enrich.column_descriptions(cat.columns(placed), enrich.description_map(rows)))
    fks = enrich.fk_descriptions(cat.foreign_keys(placed), described)
    nested = enrich.nested_entries(placed, fks, described)
    added = ["column_descriptions", "foreign_key_descriptions"]
    none = lambda c: F.coalesce(F.col(c), F.array().cast(nested.schema[c].dataType)).alias(c)
    whole = sinks.as_json(added, REST)
    lines = (nested.select("pos", REST, *map(none, added)).select("pos", whole.alias("value"))
             .unionByName(entries.join(named.select("pos"), "pos", "left_anti").select("pos", F.to_json(REST, {"ignoreNullFields": "false"}).alias("value"))))
    lines.orderBy("pos").select("value").write.mode("overwrite").text(out)
    return enrich.enrichment_report(placed, fks, described)


def build_gold_graphs(spark: SparkSession, entries_path: str, roots: list[str] | None, question_paths: list[str],
                      out: str) -> None:
    """Write one record with graph and context text per question of a known database.

    Without `roots` the entries are those that `enrich_schemas` wrote, as JSON lines, or such an array.
    """
    if roots is None:
        catalog = enrich.catalog_of_enriched(cat.latest_entries(cat.named_entries(read_enriched(spark, entries_path)), "pos"))
    else:
        catalog = enrich.enriched_catalog(*load_catalog(spark, entries_path, roots))
    catalog = graph.stored(catalog)
    files = [json_docs.read_questions(spark, p) for p in question_paths]
    log = records.file_ordinal(records.union_files(*files)).withColumnRenamed("idx", "record_key")
    log = graph.in_catalog(log, catalog)
    facts = sinks.staged(refs.query_facts(log, "record_key"), sinks.shared_folder(spark))
    sinks.write_json(graph.gold_records(log, facts, catalog, "record_key"), out)


def read_enriched(spark: SparkSession, path: str) -> DataFrame:
    """Enriched entries with `pos`, from an array or from JSON lines, whichever the first character says. Lines go by file name and
    their place in the file."""
    place = lambda *parts: F.struct(*[p.alias(n) for p, n in zip(parts, ("file", "start", "line"))]).alias("pos")
    text = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    if text is not None and text["c"] in ("[", "\ufeff"):
        entries = json_docs.read_entries(spark, path, cat.ENRICHED_SCHEMA)
        return entries.withColumn("pos", place(F.lit(""), F.lit(0).cast("long"), F.col("pos").cast("long")))
    lines = spark.read.schema(cat.ENRICHED_SCHEMA).json(path)
    return lines.select("*", place(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))


def prepare_translation(spark: SparkSession, question_path: str, out: str, stem: str, parts: int = 4) -> DataFrame:
    """Write the bilingual records, all other fields kept, in chunks for translators; returns the change report."""
    raw = json_docs.read_array(spark, question_path, json_docs.QUESTION_SCHEMA, strict=True, rest=REST).drop("path")
    numbered = records.bilingual(raw.withColumnRenamed("pos", "idx"))
    sinks.write_chunks(records.split_contiguous(numbered, parts).drop("idx"), out, stem, parts, rest=REST)
    return records.change_report(raw)


def merge_translated(spark: SparkSession, base: DataFrame, chunk_path: str, schema: str, out: str) -> None:
    """Put translated chunks back into the records and write them; later chunks win."""
    chunks = sinks.read_chunks(spark, chunk_path, schema)
    chunks = chunks.withColumn("part", F.regexp_extract("chunk", r"_part(\d+)of", 1).try_cast("int"))
    sinks.write_json(records.merge_translations(base, [chunks], order=["part"]), out)
