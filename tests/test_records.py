import pytest
from conftest import rows
from pyspark.sql import functions as F

from schemaloom.operators import browse, extremes, records

RAW = "question_id long, question string, question_en string, question_ar string, evidence_en string, extra int"


def test_bilingual(spark):
    df = spark.createDataFrame([(1, "q", None, None, None, 5), (2, None, "e", "", "", 6), (3, "q", "e", "a", "v", 7),
                                (4, None, None, "a", "v", 8)], RAW)
    out = records.bilingual(df)
    assert out.columns == ["question_id", "question_en", "question_ar", "evidence_en", "evidence_ar", "extra"]
    assert rows(out) == [(1, "q", "", "", "", 5), (2, "e", "", "", "", 6), (3, "q", "a", "v", "", 7),
                         (4, "", "a", "v", "", 8)]
    whole = df.withColumn("evidence_ar", F.lit(""))
    assert rows(whole.select("question_id", records.is_changed(whole))) == [(1, True), (2, False), (3, True), (4, True)]
    report = records.change_report(whole).first()
    assert (report["records"], report["changed"], report["legacy_question"], report["missing_question_en"]) == (4, 3, 2, 2)


@pytest.mark.parametrize("n, parts, sizes", [
    (42, 4, [11, 11, 10, 10]), (10, 3, [4, 3, 3]), (2, 4, [1, 1]), (0, 4, []), (5, 1, [5]), (5, 0, [5]), (7, 7, [1] * 7)])
def test_chunks(spark, n, parts, sizes):
    got = records.split_contiguous(spark.range(n).withColumnRenamed("id", "idx"), parts).orderBy("idx").collect()
    chunk = [r["part"] for r in got]
    assert chunk == sorted(chunk) and [chunk.count(i + 1) for i in range(len(sizes))] == sizes


def test_dense_ordinal_with_uneven_keys(spark):
    keys = [(i if i < 300 else 10**12 + i * i, "train" if i % 3 else "dev") for i in range(500)]
    got = records.dense_ordinal(spark.createDataFrame(keys, "k long, s string"), "k", ["s"], partitions=16).collect()
    for s in ("train", "dev"):
        mine = sorted((r["k"], r["idx"]) for r in got if r["s"] == s)
        assert [i for _, i in mine] == list(range(len(mine)))
    assert len(got) == 500


def test_dense_ordinal_of_nothing_and_of_null_groups(spark):
    none = spark.createDataFrame([], "k long, s string")
    assert records.dense_ordinal(none, "k").count() == 0 and records.dense_ordinal(none, "k", ["s"]).columns == ["k", "s", "idx"]
    got = records.dense_ordinal(spark.createDataFrame([(5, None), (3, None), (4, "a")], "k long, s string"), "k", ["s"])
    assert rows(got, "k", "idx") == [(3, 0), (4, 0), (5, 1)]
    names = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    assert rows(records.dense_ordinal(names, "k")) == [("a", 0), ("b", 1), ("c", 2)]


def test_ten_million_rows_in_even_ranges(spark):
    """Keys in two far apart crowds, two groups of very different size: no range has over twice the median."""
    n = 10_000_000
    key = F.when(F.col("id") < n // 2, F.col("id")).otherwise(F.col("id") * 1000 + 10**15)
    df = spark.range(n).select(key.alias("k"), F.when(F.col("id") % 100 == 0, "dev").otherwise("train").alias("s"))
    placed = records.range_placed(df, ["s", "k"], 24)
    sizes = sorted(r["n"] for r in placed.groupBy(F.shiftright("_place", 33)).agg(F.count("*").alias("n")).collect())
    assert len(sizes) == 24 and sum(sizes) == n and sizes[-1] <= 2 * sizes[12]
    got = records.dense_ordinal(df, "k", ["s"], partitions=24)
    tops = {r["s"]: tuple(r)[1:] for r in got.groupBy("s").agg(F.min("idx"), F.max("idx"), F.count_distinct("idx")).collect()}
    assert tops == {"dev": (0, n // 100 - 1, n // 100), "train": (0, n - n // 100 - 1, n - n // 100)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange rangepartitioning" not in plan and "SinglePartition" not in plan


def test_files_one_after_the_other(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, q string")
    b = spark.createDataFrame([(0, 9)], "pos int, other int")
    assert rows(records.file_ordinal(records.union_files(a, b)), "q", "other", "idx") == [
        ("a", None, 0), ("b", None, 1), (None, 9, 2)]


def test_merge_takes_the_last_filled_translation(spark):
    base = spark.createDataFrame([(1, "x", "old"), (2, "y", None), (3, "z", "keep")], "question_id int, t string, question_ar string")
    chunk = lambda *r: spark.createDataFrame(list(r), "question_id int, question_ar string")
    got = records.merge_translations(base, [chunk((1, "one"), (3, "")), chunk((1, "two"), (2, "new"), (9, "no"))],
                                     fields=("question_ar",))
    assert rows(got) == [(1, "x", "two"), (2, "y", "new"), (3, "z", "keep")]


def test_browsing(spark):
    r = spark.createDataFrame([("train", 0, "d", "Q one", "a", "SELECT 1"), ("dev", 0, "e", None, None, None)],
                              "split string, idx int, db_id string, question_en string, question_ar string, SQL string")
    assert rows(browse.db_counts(r)) == [("dev", "e", 1), ("train", "d", 1)]
    assert rows(browse.list_records(r)) == [(0, "d", "Q one", "a", "SELECT 1")]
    assert rows(browse.list_records(r, "DEV", "")) == [(0, "e", "", "", "")]
    assert browse.list_records(r, "other").count() == 0
    assert browse.record_at(r, 0).count() == 1 and browse.record_at(r, 1).count() == 0
    assert browse.search_records(r, " ONE select ").count() == 1


def test_ties_nulls_and_guards(spark):
    h = spark.createDataFrame([("a", 10), ("b", 30), ("c", 30), ("d", None)], "n string, h int")
    assert rows(extremes.tied_extreme(h, F.col("h")), "n") == [("b",), ("c",)]
    assert extremes.tied_extreme(h.filter("h is null"), F.col("h")).count() == 0
    assert rows(extremes.tied_extreme(h, F.col("h"), "min", scope=h.filter("h > 10")), "n") == [("b",), ("c",)]
    g = spark.createDataFrame([("x", 1), ("x", None), ("y", 1), ("z", 1), ("z", 2)], "g string, v int")
    assert rows(extremes.extreme_groups(g, ["g"], "max")) == [("x", 2), ("z", 2)]
    assert rows(extremes.extreme_groups(g, ["g"], "min", F.col("v"))) == [("x", 1), ("y", 1)]
    odd = spark.createDataFrame([("1997-01-02", "11", 0), ("soon", "eleven", 2), (None, None, None)], "d string, t string, n int")
    assert rows(odd.select(extremes.year_of(F.col("d")), extremes.text_equals_number(F.col("t"), 11),
                           extremes.truthy(F.col("n")), extremes.guarded_ratio(F.col("n"), F.lit(0)))) == [
        ("1997", True, False, None), (None, False, False, None), (None, False, True, None)]
