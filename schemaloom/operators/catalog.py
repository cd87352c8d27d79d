"""Schema entries (one row per database) flattened into table, column and foreign-key rows.

An entry has `db_id`, `table_names`, `table_names_original` (array<string>), `column_names`,
`column_names_original` (array of [table index, name], index -1 marks `*`) and `foreign_keys` (array of
[child index, parent index]). Indices are resolved inside the row, before the explode, so flattening needs no
join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.text import norm_alnum
from schemaloom.operators.joins import split_lookup_join

ENTRY_SCHEMA = ("db_id string, table_names array<string>, table_names_original array<string>, "
                "column_names array<array<string>>, column_names_original array<array<string>>, "
                "foreign_keys array<array<int>>")
# What `enrich.nested_entries` adds.
ENRICHED_SCHEMA = (f"{ENTRY_SCHEMA}, column_descriptions array<string>, foreign_key_descriptions array<struct<child_table "
                   "string, child_column string, parent_table string, parent_column string, summary string, usage string>>")


def _or_else(a: str, b: str) -> Column:
    """An absent or empty list is replaced by the other one."""
    return F.when(F.size(F.coalesce(F.col(a), F.array())) > 0, F.col(a)).otherwise(F.col(b))


def _canonical_tables() -> Column:
    return _or_else("table_names", "table_names_original")


def _original_tables() -> Column:
    return _or_else("table_names_original", "table_names")


def latest_entries(entries: DataFrame, pos: str) -> DataFrame:
    """One entry per database: the last by position."""
    fields = [c for c in entries.columns if c != "db_id"]
    return (entries.groupBy("db_id").agg(F.max_by(F.struct(*fields), F.col(pos)).alias("e"))
            .select("db_id", *[F.col(f"e.{c}").alias(c) for c in fields]))


def named_entries(entries: DataFrame) -> DataFrame:
    """Entries without a database id are passed over."""
    return entries.filter(F.coalesce(F.col("db_id"), F.lit("")) != "")


def tables(entries: DataFrame) -> DataFrame:
    """(db_id, t_idx, original, canonical)"""
    zipped = F.arrays_zip(_original_tables().alias("o"), _canonical_tables().alias("c"))
    return (named_entries(entries)
            .select("db_id", F.posexplode(zipped).alias("t_idx", "t"))
            .select("db_id", "t_idx", F.coalesce("t.o", "t.c").alias("original"),
                    F.coalesce("t.c", "t.o").alias("canonical")))


def columns(entries: DataFrame) -> DataFrame:
    """(db_id, col_idx, t_idx, original, canonical, table_original, table_canonical)

    The two name spaces stay apart: descriptions and foreign keys go by original names, graph nodes by
    canonical ones. The `*` column has t_idx -1 and `*` for both table names.
    """
    zipped = F.arrays_zip(_or_else("column_names_original", "column_names").alias("o"),
                          _or_else("column_names", "column_names_original").alias("c"))

    def read(z: Column, i: Column) -> Column:
        t_idx = F.coalesce(F.get(z["o"], F.lit(0)), F.get(z["c"], F.lit(0))).cast("int")
        original = F.coalesce(F.get(z["o"], F.lit(1)), F.get(z["c"], F.lit(1)))
        canonical = F.coalesce(F.get(z["c"], F.lit(1)), F.get(z["o"], F.lit(1)))
        star = t_idx == -1
        table = lambda names: F.when(star, "*").otherwise(F.get(names, t_idx))
        return F.struct(
            i.alias("col_idx"), t_idx.alias("t_idx"), original.alias("original"),
            F.when(star, "*").otherwise(canonical).alias("canonical"),
            table(_original_tables()).alias("table_original"),
            F.coalesce(table(_canonical_tables()), table(_original_tables())).alias("table_canonical"))

    return (named_entries(entries)
            .select("db_id", F.explode(F.transform(zipped, read)).alias("c"))
            .select("db_id", "c.*"))


def _fk_rows(entries: DataFrame) -> DataFrame:
    names = _or_else("column_names_original", "column_names")

    def end(idx: Column, prefix: str) -> list[Column]:
        # `get` gives null outside the list, negative indices included.
        entry = F.get(names, idx)
        t_idx = F.get(entry, F.lit(0)).cast("int")
        return [idx.alias(f"{prefix}_idx"),
                F.get(_original_tables(), t_idx).alias(f"{prefix}_table"),
                F.when(t_idx >= 0, F.get(entry, F.lit(1))).alias(f"{prefix}_column")]

    pair = lambda p, i: F.struct(i.alias("fk_pos"), F.size(p).alias("width"),
                                 *end(F.get(p, F.lit(0)).cast("int"), "child"),
                                 *end(F.get(p, F.lit(1)).cast("int"), "parent"))
    return (named_entries(entries)
            .select("db_id", F.explode(F.transform("foreign_keys", pair)).alias("f"))
            .select("db_id", "f.*"))


def _resolved() -> Column:
    return (F.col("child_table").isNotNull() & F.col("child_column").isNotNull()
            & F.col("parent_table").isNotNull() & F.col("parent_column").isNotNull())


def foreign_keys(entries: DataFrame) -> DataFrame:
    """(db_id, fk_pos, child_idx, child_table, child_column, parent_idx, parent_table, parent_column)

    Entries that are not pairs are passed over; pairs that point at `*` or outside the list are dropped and
    counted by `dropped_foreign_keys`.
    """
    return _fk_rows(entries).filter((F.col("width") == 2) & _resolved()).drop("width")


def dropped_foreign_keys(entries: DataFrame) -> DataFrame:
    """(db_id, dropped): pairs whose ends do not name two columns."""
    bad = _fk_rows(entries).filter((F.col("width") == 2) & ~_resolved())
    return bad.groupBy("db_id").agg(F.count("*").alias("dropped"))


def table_columns(cols: DataFrame) -> DataFrame:
    """(db_id, table_name, columns): the columns of each canonical table in index order.

    `cols` are rows of `columns` with a `description`. Tables that share a canonical name are merged. The list
    is as long as one table is wide; it is the shape a graph node has.
    """
    entry = F.struct("col_idx", F.col("canonical").alias("name"), "description")
    return (cols.filter("t_idx >= 0")
            .groupBy("db_id", F.col("table_canonical").alias("table_name"))
            .agg(F.sort_array(F.collect_list(entry)).alias("columns"))
            .withColumn("columns", F.transform("columns", lambda c: F.struct(c["name"], c["description"]))))


def unique_owners(cols: DataFrame) -> DataFrame:
    """(db_id, name, owner): column names that exactly one canonical table of the database has."""
    return (cols.filter("t_idx >= 0").groupBy("db_id", F.col("canonical").alias("name"))
            .agg(F.min("table_canonical").alias("owner"), F.max("table_canonical").alias("other"))
            .filter("owner = other").drop("other"))


def table_names(tabs: DataFrame, cols: DataFrame) -> DataFrame:
    """(db_id, name_key, candidates): every way a table may be written, by lower-case name.

    Candidates are (rank, exact, canonical), best rank first: 0 canonical name of a table with columns, 1
    original name, 2 original name in any case (`exact` is null). Within a rank the last table wins.
    """
    named = cols.filter("t_idx >= 0").groupBy("db_id", "table_canonical").agg(F.max("t_idx").alias("t_idx"))
    with_columns = named.select(
        "db_id", F.lit(0).alias("rank"), F.col("table_canonical").alias("exact"),
        F.col("table_canonical").alias("canonical"), F.col("t_idx"), F.lower("table_canonical").alias("name_key"))
    ways = F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.col("original").alias("exact")),
                             F.struct(F.lit(2).alias("rank"), F.lit(None).cast("string").alias("exact"))))
    written = tabs.select("db_id", ways.alias("w"), "canonical", "t_idx", F.lower("original").alias("name_key"))
    written = written.select("db_id", "w.rank", "w.exact", "canonical", "t_idx", "name_key")
    return (with_columns.unionByName(written).repartition("db_id")  # for all groups below
            .groupBy("db_id", "name_key", "rank", "exact").agg(F.max_by("canonical", "t_idx").alias("canonical"))
            .groupBy("db_id", "name_key")
            .agg(F.collect_list(F.struct("rank", "exact", "canonical")).alias("candidates")))


def canonical_name(name: Column, candidates: Column) -> Column:
    """The best candidate that fits the name as written; null if there is none."""
    fitting = F.filter(candidates, lambda c: (c["rank"] == 2) | (c["exact"] == name))
    return F.array_min(fitting)["canonical"]


def borrowed_columns(tabs: DataFrame, cols: DataFrame) -> DataFrame:
    """(db_id, table_name, shown_as): tables without columns and the last table whose name has the same letters."""
    known = cols.filter("t_idx >= 0").groupBy("db_id", F.col("table_canonical").alias("shown_as")).agg(
        F.min("col_idx").alias("first_idx"))
    by_letters = (known.groupBy("db_id", norm_alnum(F.col("shown_as")).alias("letters"))
                  .agg(F.max_by("shown_as", "first_idx").alias("shown_as")))
    bare = (tabs.select("db_id", F.col("canonical").alias("table_name")).distinct()
            .join(known.select("db_id", F.col("shown_as").alias("table_name")), ["db_id", "table_name"], "left_anti"))
    return (bare.withColumn("letters", norm_alnum(F.col("table_name")))
            .join(by_letters, ["db_id", "letters"]).drop("letters"))


@dataclass(frozen=True)
class Catalog:
    """Flat schema tables plus the texts attached to them."""

    databases: DataFrame  # (db_id): all of the entries, also those without tables
    tables: DataFrame
    columns: DataFrame  # names alone, so that resolving names does not work out descriptions
    described: DataFrame  # rows of `columns` with `description`
    fk_texts: DataFrame  # (db_id, child_table, child_column, parent_table, parent_column, description)

    # lookups by name, stored in buckets of their keys (`stored`)
    lookups: dict[str, DataFrame] = field(default_factory=dict)

    def lookup(self, rows: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
        return split_lookup_join(rows, table, on, how)

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stored lookup of that name, or what `make` works out."""
        return self.lookups[name] if name in self.lookups else make()

    def stored(self, store: Callable[[DataFrame, list[str], str], DataFrame], lookups: dict[str, tuple[DataFrame, list[str]]]) -> Catalog:
        """The same catalog with `lookups` ({name: (table, its keys)}) stored."""
        return replace(self, lookups={name: store(table, keys, name) for name, (table, keys) in lookups.items()})

    def lists_by_db(self) -> DataFrame:
        """(db_id, lists): the columns of each canonical table by its name, borrowed lists included; a row per database."""
        own = by_db(table_columns(self.described), "table_name", F.col("columns"), "own")
        borrowed = borrowed_columns(self.tables, self.columns).groupBy("db_id").agg(F.collect_list(F.struct("table_name", "shown_as")).alias("borrowed"))
        more = F.map_from_entries(F.transform("borrowed", lambda b: F.struct(b["table_name"], F.try_element_at("own", b["shown_as"]).alias("columns"))))
        return (own.join(borrowed.hint("merge"), "db_id", "left")
                .select("db_id", F.when(F.size("borrowed") > 0, F.map_concat("own", more)).otherwise(F.col("own")).alias("lists")))

    def column_lists(self) -> DataFrame:
        """(db_id, table_name, columns) for every canonical table, borrowed lists included."""
        return self.lists_by_db().select("db_id", F.explode("lists").alias("table_name", "columns"))


def by_db(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """(db_id, `name`): a database's rows as one map, as large as its schema. `key` is unique in a database; null finds nothing."""
    entry = F.struct(F.col(key).alias("key"), value.alias("value"))
    return rows.filter(F.col(key).isNotNull()).groupBy("db_id").agg(F.map_from_entries(F.collect_list(entry)).alias(name))


def databases(entries: DataFrame) -> DataFrame:
    return named_entries(entries).select("db_id").distinct()


def plain_catalog(entries: DataFrame) -> Catalog:
    """A catalog without descriptions."""
    empty = F.lit("").alias("description")
    texts = foreign_keys(entries).select(
        "db_id", "child_table", "child_column", "parent_table", "parent_column", empty).distinct()
    cols = columns(entries)
    return Catalog(databases(entries), tables(entries), cols, cols.select("*", empty), texts)
