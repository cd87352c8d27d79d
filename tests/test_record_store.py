import os
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from schemaloom.operators import browse
from schemaloom.sources import record_store as RS

WORDS = ["alpha", "Beta", "gamma", "the", "or", "ü", "Straße", "x", "SELECT", "日本語", "😀", "a'b", "100%"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rnd = random.Random(1)
    text = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 8)))
    data = [(i * 7 % 1009, rnd.choice(["train", "train", "dev", None]), rnd.choice(["hot"] * 5 + ["a", "b", "c d/e", None]), text(), rnd.choice([None, "", "ar"]),
             rnd.choice([None, text()]), i) for i in range(400)] + [(5000, "train", "a", "long " * 20_000 + "needle", "", "", 0)]
    df = spark.createDataFrame(data, "question_id long, split string, db_id string, question_en string, question_ar string, SQL string, extra int")
    folder = str(tmp_path_factory.mktemp("store") / "s")
    RS.write_store(df, folder, "question_id", rows=32)
    return df, RS.open_store(spark, folder)


def plain(df):
    """The same records numbered by hand."""
    out, at = [], {}
    for r in sorted(df.collect(), key=lambda r: r["question_id"]):
        at[r["split"]] = at.get(r["split"], -1) + 1
        out.append({**r.asDict(), "idx": at[r["split"]]})
    return out


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_record_is_at_its_ordinal(made):
    df, store = made
    want = plain(df)
    for idx, split in ((0, None), (11, "TRAIN"), (31, "train"), (32, "train"), (40, "dev"), (-1, "dev"), (10**6, "train"), (0, "none")):
        mine = [r for r in want if r["split"] == (split or "train").lower() and r["idx"] == idx]
        got = store.record_at(idx, split)
        assert sorted(got.columns) == sorted([*df.columns, "idx"])
        assert [r.asDict() for r in got.collect()] == [{c: r[c] for c in got.columns} for r in mine]
    assert rows(store.records().select("split", "question_id", "idx")) == sorted(((r["split"], r["question_id"], r["idx"]) for r in want), key=repr)


def test_a_lookup_reads_one_file(made):
    _, store = made
    plan = plan_of(store.record_at(40, "train"))
    assert re.search(r"PartitionFilters: \[[^]]*split[^]]*= train[^]]*block[^]]*= 1\)", plan) and "EqualTo(idx,40)" in plan
    files = os.listdir(f"{store.folder}/records/split=train/block=1")
    assert len([f for f in files if f.endswith(".parquet")]) == 1
    listed = store.list_records("train", "b")
    assert re.search(r"PartitionFilters: \[[^]]*split[^]]*= train[^]]*db_part", plan_of(listed)) and "EqualTo(db_id,b)" in plan_of(listed)
    assert not re.search("Window|Exchange", plan + plan_of(listed))


@pytest.mark.parametrize("split", [None, "dev"])
@pytest.mark.parametrize("db_id", [None, "", "hot", "c d/e", "nobody"])
def test_lists_and_counts(made, split, db_id):
    df, store = made
    filled = lambda r: (r["idx"], r["db_id"], r["question_en"] or "", r["question_ar"] or "", r["SQL"] or "")
    mine = [r for r in plain(df) if r["split"] == (split or "train") and (not db_id or r["db_id"] == db_id)]
    assert rows(store.list_records(split, db_id)) == sorted(map(filled, mine), key=repr)
    assert rows(store.db_counts()) == rows(browse.db_counts(df))


@pytest.mark.parametrize("term", ["", " ", "x", "or", "the", " THE ", "alpha beta", "a or", "straße", "日本語", "😀 x", "a'b", "100%", "needle", "gng", "zzz", "long long", "or or the"])
@pytest.mark.parametrize("split, db_id", [("train", None), ("dev", "hot")])
def test_search_finds_what_a_scan_finds(spark, made, term, split, db_id):
    df, store = made
    numbered = spark.createDataFrame([tuple(r.values()) for r in plain(df)], StructType([*df.schema, StructField("idx", LongType())]))
    scan = browse.search_records(numbered, term, split, db_id)
    got = store.search(term, split, db_id)
    assert rows(got) == rows(scan)
    if len(term.strip()) >= 3:
        assert rows(got) == rows(store.candidates(term, split).join(got.withColumnRenamed("idx", "i"), F.col("i") == F.col("idx")).select(
            "idx", "db_id", "question_en", "question_ar", "SQL"))


def test_only_blocks_with_candidates_are_read(made):
    _, store = made
    assert store.candidates("needle").count() == 1
    plan = plan_of(store.search("needle"))
    block = store.candidates("needle").first()["block"]
    assert re.search(rf"PartitionFilters: \[[^]]*split[^]]*= train[^]]*block[^]]*{block}\)", plan)
    assert store.candidates("zzz").count() == 0 and store.search("zzz").count() == 0


def test_an_empty_store(spark, tmp_path):
    none = spark.createDataFrame([], "question_id long, split string, db_id string, question_en string, question_ar string, SQL string")
    store = RS.write_store(none, str(tmp_path / "s"), "question_id")
    assert store.record_at(0).count() == store.search("abc").count() == store.list_records().count() == store.db_counts().count() == 0


def test_postings_are_lists_of_runs_of_rows(spark, made, monkeypatch):
    _, store = made
    kept = store.records().select("split", "block", "idx", RS._text().alias("text")).collect()
    want = {(r["split"], r["text"][i:i + 3], r["block"], r["idx"] % 32) for r in kept for i in range(len(r["text"]) - 2)}
    postings = spark.read.parquet(f"{store.folder}/postings").selectExpr("CAST(split AS string) AS split", "gram", "block", "at").collect()
    missing = lambda s: None if s == "__HIVE_DEFAULT_PARTITION__" else s
    assert {(missing(r["split"]), r["gram"], r["block"], at) for r in postings for at in r["at"]} == want
    assert len(postings) < len(want) / 3  # no row per piece and text
    monkeypatch.setattr(RS, "LETTERS", 50)
    made_of = lambda rows: {(b, g, a) for x in RS._posted(iter([RS.pa.RecordBatch.from_arrays(
        [RS.pa.array(c) for c in zip(*rows)], ["split", "block", "at", "text"])])) for b, g, at in zip(x["block"].to_pylist(), x["gram"].to_pylist(), x["at"].to_pylist()) for a in at}
    rows_ = [("a", k // 3, k % 3, t.encode()) for k, t in enumerate(["x" * 60 + "yz" * 40, "", "ab", "日本語" * 30, "abc", "q"])]
    assert made_of(rows_) == {(b, t.decode()[i:i + 3], at) for _, b, at, t in rows_ for i in range(len(t.decode()) - 2)}


def test_texts_with_very_many_characters_are_taken_in_halves(monkeypatch):
    whole = RS.grams

    def small(texts):
        if len(texts) > 1:
            raise OverflowError
        return whole(texts)

    monkeypatch.setattr(RS, "grams", small)
    texts = ["abcd", "", "bcde", "abc", "日本語"]
    got = {(g, k) for b in RS._lists("a", 0, [0, 1, 2, 3, 4], texts) for g, at in zip(b["gram"].to_pylist(), b["at"].to_pylist()) for k in at}
    assert got == {(t[i:i + 3], k) for k, t in enumerate(texts) for i in range(len(t) - 2)}
