import pytest
from pyspark.sql import functions as F

from schemaloom.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, key, letters", [
    (None, "", ""), (" CDS Code ", "cdscode", "cdscode"), ("set_Translations-2", "settranslations2", "settranslations2"),
    ("Étage 1", "tage1", "étage1"), ("数据", "", "数据")])
def test_name_keys(spark, text, key, letters):
    c = F.lit(text).cast("string")
    assert one(spark, T.norm_key(c)) == key
    assert one(spark, T.norm_alnum(c)) == letters


@pytest.mark.parametrize("text, tidy", [
    ("", ""), (None, ""), ("a  b", "a b."), (" a \n b. ", "a b."), ("a...", "a."), ("a . .", "a . ."), ("   ", ".")])
def test_tidy_text_ends_in_one_period(spark, text, tidy):
    assert one(spark, T.tidy_text(F.lit(text).cast("string"))) == tidy


@pytest.mark.parametrize("child, parent, extra", [
    ("", "", ""), ("", "unique id", " unique id."), ("id of school", "", ""),
    ("School Code", "school code", " school code."), ("CDS Code of the school", "CDSCode", " CDSCode."),
    ("school", "the school code", " school."), ("owner", "—", " —."), ("first line\nsecond", "other", " first line second.")])
def test_fk_summary(spark, child, parent, extra):
    got = one(spark, T.fk_summary(*[F.lit(x) for x in ("A", "x", "B", "y", child, parent)]))
    assert got == "A.x references B.y." + extra


def test_first_filled_and_lines(spark):
    null = F.lit(None).cast("string")
    assert one(spark, T.first_filled(null, F.lit(""), F.lit("c"))) == "c"
    assert one(spark, T.first_filled(null, F.lit(""))) == ""
    assert one(spark, T.labelled(F.lit("n"), F.lit(""))) == "n"
    assert one(spark, T.edge_line(*[F.lit(x) for x in ("A", "a", "B", "b", "why")])) == "A.a → B.b (why)"
    assert one(spark, T.edge_line(*[F.lit(x) for x in ("A", "a", "B", "b", "")])) == "A.a → B.b"


def test_search_term(spark):
    row = spark.createDataFrame([("How Many?", "SELECT 1"), (None, "x")], "q string, s string")
    found = lambda term: row.filter(T.contains_term(term, F.col("q"), F.col("s"))).count()
    assert [found("many? select"), found("  "), found("X"), found("zzz")] == [1, 2, 1, 0]


@pytest.mark.parametrize("text, name, hit", [
    ("use line item now", "line item", True), ("use lineitem", "line", False), ("a (b) c", "b", True),
    ("price in $x", "x", True), ("a.b*c", "b*c", True), ("zürich", "z", False)])
def test_whole_word_takes_the_name_literally(spark, text, name, hit):
    df = spark.createDataFrame([(text, name)], "t string, n string")
    assert df.select(T.whole_word(F.col("t"), F.col("n"))).first()[0] is hit
