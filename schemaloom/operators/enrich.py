"""Descriptions for columns and foreign keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.text import filled, first_filled, fk_summary, fk_usage, norm_key, strip
from schemaloom.operators import catalog
from schemaloom.operators.joins import lookup_join
from schemaloom.sources import sinks


def description_lists(rows: DataFrame) -> DataFrame:
    """(db_id, table_key, keys): the (col_key, description) of each table key, from the rows of the description files.

    `rows`: db_id, file (name without extension), row_no, original_column_name, column_name,
    column_description. Both names of a row are keys; the first non-empty text of a key wins. Of several files
    with one table key only the last that has any key counts.
    """
    # One shuffle, by database: the groups below it are of finer keys and need no other.
    dealt = rows.filter("db_id is not null and file is not null").select("db_id", "file", "row_no", "original_column_name", "column_name", "column_description").repartition("db_id")
    names = F.posexplode(F.array(norm_key(F.col("original_column_name")), norm_key(F.col("column_name"))))
    keyed = (dealt.select("db_id", "file", "row_no",
                          strip(F.col("column_description")).alias("text"), names.alias("which", "col_key"))
             .filter("col_key <> ''"))
    merged = keyed.groupBy("db_id", "file", "col_key").agg(
        filled(F.min_by("text", F.when(F.col("text") != "", F.struct("row_no", "which")))).alias("description"))
    # a file's keys as one list, so that picking the last file is no join
    files = merged.groupBy("db_id", "file").agg(F.collect_list(F.struct("col_key", "description")).alias("keys"))
    return files.groupBy("db_id", norm_key(F.col("file")).alias("table_key")).agg(F.max_by("keys", "file").alias("keys"))


def description_map(rows: DataFrame) -> DataFrame:
    """(db_id, table_key, col_key, description): `description_lists`, a row per key."""
    return (description_lists(rows).select("db_id", "table_key", F.explode(F.transform("keys", lambda k: k)).alias("k"))
            .select("db_id", "table_key", "k.*"))


def column_descriptions(cols: DataFrame, descriptions: DataFrame) -> DataFrame:
    """`columns` rows with `description`, '' where there is none. `descriptions` are rows of `description_map`."""
    return listed_descriptions(cols, descriptions.groupBy("db_id", "table_key").agg(F.collect_list(F.struct("col_key", "description")).alias("keys")))


def listed_descriptions(cols: DataFrame, lists: DataFrame) -> DataFrame:
    """`column_descriptions` from `description_lists`, which need not be taken apart and collected again.

    A table's file is looked up by its original name; only if there is no such file, by its canonical name. Columns meet the
    descriptions by database alone: a row per database has its files and their keys.
    """
    keys = F.map_from_entries("keys").alias("keys")
    files = lists.groupBy("db_id").agg(F.map_from_entries(F.collect_list(F.struct("table_key", keys))).alias("files"))
    found = lookup_join(cols, files.hint("merge"), ["db_id"])
    file = lambda name: F.try_element_at("files", norm_key(F.col(name)))
    keys = F.coalesce(file("table_original"), file("table_canonical"))
    text = F.when(F.col("t_idx") >= 0, F.try_element_at(keys, norm_key(F.col("original"))))
    return found.select(*cols.columns, filled(text).alias("description"))


def _texts_by_db(described: DataFrame) -> DataFrame:
    """(db_id, texts): the descriptions of a database's columns, in the order of the columns."""
    return described.groupBy("db_id").agg(F.sort_array(F.collect_list(F.struct("col_idx", "description"))).alias("texts"))


def fk_descriptions(fks: DataFrame, described: DataFrame) -> DataFrame:
    """Foreign keys with both ends' descriptions, a summary and a usage line."""
    both = lookup_join(fks, _texts_by_db(described).hint("merge"), ["db_id"])
    for end in ("child", "parent"):
        idx = F.col(f"{end}_idx")
        found = F.transform(F.filter("texts", lambda t: t["col_idx"] == idx), lambda t: t["description"])  # noqa: B023
        both = both.select("*", F.explode_outer(found).alias(f"{end}_description"))
    ends = [F.col(c) for c in ("child_table", "child_column", "parent_table", "parent_column")]
    child, parent = filled(F.col("child_description")), filled(F.col("parent_description"))
    return both.select("db_id", "fk_pos", *ends, child.alias("child_description"),
                       parent.alias("parent_description"),
                       fk_summary(*ends, child, parent).alias("summary"), fk_usage(*ends).alias("usage"))


FK_ENDS = ["child_table", "child_column", "parent_table", "parent_column"]


def fk_texts(fk_rows: DataFrame) -> DataFrame:
    """(db_id, four names, description): one text per foreign key, the last wins."""
    return (fk_rows.groupBy("db_id", *FK_ENDS)
            .agg(F.max_by(first_filled(F.col("summary"), F.col("usage")), F.col("fk_pos")).alias("description")))


def enriched_catalog(entries: DataFrame, rows: DataFrame) -> catalog.Catalog:
    """Schema entries and description rows as one catalog, written to the shared folder once: what uses it several times
    reads files instead of working out descriptions again. Its tables are in buckets of the database, by which they are
    grouped and joined from then on."""
    spark = entries.sparkSession
    keep = lambda df, placed=False: sinks.bucketed(df, ["db_id"], sinks.shared_folder(spark), placed)
    described = keep(listed_descriptions(catalog.columns(entries), description_lists(rows)), True)
    texts = keep(fk_texts(fk_descriptions(catalog.foreign_keys(entries), described)), True)
    return catalog.Catalog(keep(catalog.databases(entries)), keep(catalog.tables(entries)), described.drop("description"),
                           described, texts)


def catalog_of_enriched(entries: DataFrame) -> catalog.Catalog:
    """The catalog of entries that carry their descriptions already (`catalog.ENRICHED_SCHEMA`)."""
    named = catalog.named_entries(entries)
    texts = named.select("db_id", F.posexplode("column_descriptions").alias("col_idx", "description"))
    cols = catalog.columns(entries)
    described = lookup_join(cols, texts, ["db_id", "col_idx"]).select(*cols.columns, filled(F.col("description")).alias("description"))
    keys = named.select("db_id", F.posexplode("foreign_key_descriptions").alias("fk_pos", "k")).select("db_id", "fk_pos", "k.*")
    keep = lambda df: sinks.staged(df, sinks.shared_folder(entries.sparkSession))
    described = keep(described)
    return catalog.Catalog(keep(catalog.databases(entries)), keep(catalog.tables(entries)), described.drop("description"),
                           described, keep(fk_texts(keys)))


def enrichment_report(entries: DataFrame, fk_rows: DataFrame, described: DataFrame, by_db: bool = False) -> DataFrame:
    """Counts of databases, of foreign keys and columns left without text, and of dropped foreign keys."""
    zero = F.lit(0).cast("long")

    def part(df: DataFrame, **counts) -> DataFrame:
        names = ("databases", "missing_fk_descriptions", "missing_column_descriptions", "dropped_fks")
        return df.select("db_id", *[counts.get(n, zero).cast("long").alias(n) for n in names])

    bare_fk = (F.col("child_description") == "") & (F.col("parent_description") == "")
    bare_column = (F.col("t_idx") >= 0) & (F.col("description") == "")
    parts = (part(catalog.named_entries(entries), databases=F.lit(1))
             .unionByName(part(fk_rows, missing_fk_descriptions=bare_fk))
             .unionByName(part(described, missing_column_descriptions=bare_column))
             .unionByName(part(catalog.dropped_foreign_keys(entries), dropped_fks=F.col("dropped"))))
    grouped = parts.groupBy("db_id") if by_db else parts.groupBy()
    return grouped.agg(*[F.sum(c).alias(c) for c in parts.columns if c != "db_id"])


def nested_entries(entries: DataFrame, fk_rows: DataFrame, described: DataFrame) -> DataFrame:
    """The entries with `foreign_key_descriptions` and `column_descriptions` attached, for writing out."""
    texts = _texts_by_db(described).select("db_id", F.transform("texts", lambda t: t["description"]).alias("column_descriptions"))
    fields = [c for c in fk_rows.columns if c not in ("db_id", "fk_pos")]
    keys = (fk_rows.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("fk_pos", *fields))).alias("k"))
            .select("db_id", F.transform("k", lambda k: F.struct(*[k[f].alias(f) for f in fields]))
                    .alias("foreign_key_descriptions")))
    return entries.join(texts, "db_id", "left").join(keys, "db_id", "left")
