from conftest import rows
from pyspark.sql import functions as F

from schemaloom.operators import catalog, enrich

ROWS = ("db_id string, file string, row_no int, original_column_name string, column_name string, "
        "column_description string")


def entry(db="d", tables=("a", "b"), canonical=None, columns=((-1, "*"), (0, "x"), (1, "y")), named=None, fks=()):
    texts = lambda cols: None if cols is None else [[str(t), n] for t, n in cols]
    return (db, canonical, list(tables), texts(named), texts(columns), [list(p) for p in fks])


def entries(spark, *items):
    return spark.createDataFrame(list(items), catalog.ENTRY_SCHEMA)


def test_names_fall_back_both_ways(spark):
    e = entries(spark, entry(canonical=["A a"]), entry("e", canonical=[]))
    assert rows(catalog.tables(e)) == [("d", 0, "a", "A a"), ("d", 1, "b", "b"), ("e", 0, "a", "a"), ("e", 1, "b", "b")]
    cols = rows(catalog.columns(e.filter("db_id = 'd'")))
    assert cols == [("d", 0, -1, "*", "*", "*", "*"), ("d", 1, 0, "x", "x", "a", "A a"), ("d", 2, 1, "y", "y", "b", "b")]


def test_bad_foreign_keys_are_dropped_and_counted(spark):
    e = entries(spark, entry(fks=[(1, 2), (2,), (0, 1), (1, 99), (-1, 1), (1, 2, 3)]))
    assert rows(catalog.foreign_keys(e), "fk_pos", "child_table", "child_column", "parent_column") == [(0, "a", "x", "y")]
    assert rows(catalog.dropped_foreign_keys(e)) == [("d", 3)]


def test_last_entry_of_a_database_wins_and_unnamed_ones_are_passed_over(spark):
    e = spark.createDataFrame([("d", 0, "old"), ("d", 2, "new"), ("d", 1, "mid")], "db_id string, pos int, v string")
    assert rows(catalog.latest_entries(e, "pos"), "db_id", "v") == [("d", "new")]
    assert catalog.tables(entries(spark, entry(db=None), entry(db=""))).count() == 0


def test_first_filled_description_wins(spark):
    r = spark.createDataFrame([("d", "t", 0, "a", "Alpha", ""), ("d", "t", 1, "A", "", " text 1 "),
                               ("d", "t", 2, "a", None, "text 2"), ("d", "t", 3, None, "", "lost")], ROWS)
    assert rows(enrich.description_map(r)) == [("d", "t", "a", "text 1"), ("d", "t", "alpha", "")]


def test_last_file_of_a_table_replaces_the_others_unless_empty(spark):
    r = spark.createDataFrame([("d", "My T", 0, "a", "", "old"), ("d", "My T", 1, "only", "", "old"),
                               ("d", "my_t", 0, "a", "", "new"), ("d", "myt", 0, "", "--", "no key")], ROWS)
    assert rows(enrich.description_map(r)) == [("d", "myt", "a", "new")]


def test_canonical_file_is_used_only_without_an_original_one(spark):
    e = entries(spark, entry(canonical=["first", "second"]))
    r = spark.createDataFrame([("d", "a", 0, "other", "", "x"), ("d", "first", 0, "x", "", "never"),
                               ("d", "second", 0, "Y", "", "found")], ROWS)
    got = enrich.column_descriptions(catalog.columns(e), enrich.description_map(r))
    assert rows(got, "col_idx", "description") == [(0, ""), (1, ""), (2, "found")]


def test_report(spark):
    e = entries(spark, entry(fks=[(1, 2), (0, 1)]), entry("e"))
    r = spark.createDataFrame([("d", "a", 0, "x", "", "the x")], ROWS)
    c = enrich.enriched_catalog(e, r)
    fks = enrich.fk_descriptions(catalog.foreign_keys(e), c.described)
    assert rows(enrich.enrichment_report(e, fks, c.described)) == [(2, 0, 3, 1)]
    assert rows(enrich.enrichment_report(e, fks, c.described, by_db=True)) == [("d", 1, 0, 1, 1), ("e", 1, 0, 2, 0)]
    nested = enrich.nested_entries(e, fks, c.described).filter("db_id = 'd'").first()
    assert nested["column_descriptions"] == ["", "the x", ""]
    assert nested["foreign_key_descriptions"][0]["summary"] == "a.x references b.y."
    assert nested["foreign_key_descriptions"][0]["usage"] == "Foreign key linking a.x to b.y"


def test_fk_text_of_a_repeated_key_is_the_last(spark):
    fk = spark.createDataFrame([("d", 0, "a", "x", "b", "y", "one", "u"), ("d", 1, "a", "x", "b", "y", "", "use")],
                               "db_id string, fk_pos int, child_table string, child_column string, parent_table string, "
                               "parent_column string, summary string, usage string")
    assert rows(enrich.fk_texts(fk), "description") == [("use",)]


def test_tables_without_columns_borrow_by_letters(spark):
    e = entries(spark, entry(tables=("t one", "T-ONE", "z"), canonical=["t one", "T-ONE", "z"],
                             columns=((-1, "*"), (0, "x"))))
    c = catalog.plain_catalog(e)
    got = {r["table_name"]: [x["name"] for x in r["columns"]] for r in c.column_lists().collect()}
    assert got == {"t one": ["x"], "T-ONE": ["x"]}


def test_unique_owner(spark):
    e = entries(spark, entry(columns=((-1, "*"), (0, "x"), (1, "x"), (1, "y"), (1, "y"))))
    assert rows(catalog.unique_owners(catalog.columns(e))) == [("d", "y", "b")]


def test_table_name_order_of_preference(spark):
    e = entries(spark, entry(tables=("Orders", "orders", "items"), canonical=["sales", "items", "lines"],
                             columns=((-1, "*"), (0, "x"), (1, "y"), (2, "z"))))
    index = catalog.table_names(catalog.tables(e), catalog.columns(e))
    asked = spark.createDataFrame([(n,) for n in ("items", "orders", "Orders", "ORDERS", "Items", "none", "sales")],
                                  "name string").withColumn("name_key", F.lower("name"))
    got = asked.join(index, "name_key").select(
        "name", catalog.canonical_name(F.col("name"), F.col("candidates")).alias("c")).filter("c is not null")
    assert dict(rows(got)) == {"items": "items", "orders": "items", "Orders": "sales", "ORDERS": "items",
                               "Items": "lines", "sales": "sales"}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_descriptions_are_dealt_out_once_by_database(spark):
    e = entries(spark, entry(fks=[(1, 2)]), entry("e"))
    r = spark.createDataFrame([("d", "a", 0, "x", "", "the x"), ("d", "b", 0, "y", "", "the y"), (None, "a", 0, "x", "", "lost")], ROWS)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = enrich.column_descriptions(catalog.columns(e), enrich.description_map(r))
        assert exchanges(got) == 2  # the rows of the files, and the columns
        assert rows(got, "db_id", "description") == [("d", ""), ("d", "the x"), ("d", "the y"), ("e", ""), ("e", ""), ("e", "")]
        c = enrich.enriched_catalog(e, r)
        fks = enrich.fk_descriptions(catalog.foreign_keys(e), c.described)
        assert exchanges(fks) == 1 and exchanges(enrich.nested_entries(e, fks, c.described)) == 2  # entries and their keys; no description
        assert rows(fks, "child_description", "parent_description") == [("the x", "the y")]
        # a database with two entries has each pair of texts
        twice = e.unionByName(e.filter("db_id = 'd'"))
        described = enrich.column_descriptions(catalog.columns(twice), enrich.description_map(r))
        assert enrich.fk_descriptions(catalog.foreign_keys(twice), described).count() == 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
