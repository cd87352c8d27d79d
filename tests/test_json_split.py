import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from schemaloom.sources import json_docs, json_split

ODD = ['}', '{', '[{]}', '"', '\\', '\\"', '"}', '{"a": "}"', ']', ',', 'x}, {"id": 9}', "\n", "é😀", ""]


def value(rnd, deep=0):
    k = rnd.randrange(9 if deep < 3 else 5)
    if k < 2:
        return "".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 4)))
    if k < 5:
        return rnd.choice([None, True, 1, -2.5, 10**9])
    if k < 7:
        return [value(rnd, deep + 1) for _ in range(rnd.randint(0, 3))]
    return {rnd.choice(ODD) + str(i): value(rnd, deep + 1) for i in range(rnd.randint(0, 3))}


def array(rnd, n):
    """Objects among strings, numbers and arrays that hold objects; any indentation."""
    items = [({"id": i, "text": "".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 5))) if rnd.random() < 0.8 else "y" * rnd.randint(1, 400), "more": value(rnd)} if rnd.random() < 0.7 else value(rnd, rnd.choice([0, 2]))) for i in range(n)]
    return items, json.dumps(items, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 0, 2]), separators=rnd.choice([None, (",", ":")]))


def expected(name, items):
    return [(name, pos, x.get("id"), x.get("text")) for pos, x in enumerate(items) if isinstance(x, dict)]


def got(df):
    return sorted(((r["path"].rsplit("/", 1)[1], r["pos"], r["id"], r["text"]) for r in df.collect()), key=repr)



@pytest.mark.parametrize("size", ["64", "1000", "100000"])
def test_arrays_in_any_ranges(spark, tmp_path, size):
    rnd = random.Random(int(size))
    want, texts = [], {}
    for k in range(6 if size == "64" else 12):
        items, text = array(rnd, rnd.choice([0, 1, 5, 12]) if size == "64" else rnd.choice([0, 3, 60]))
        text = rnd.choice(["", "\n ", "﻿"]) + text + rnd.choice(["", " \n"])
        texts[f"f{k}.json"] = text
        want += expected(f"f{k}.json", items)
    for name, text in {**texts, "cut.json": texts["f0.json"][:-3] if len(texts["f0.json"]) > 6 else '[{"id": 1}, {', "object.json": '{"id": 1}', "two.json": '[{"id": 1}] [{"id": 2}]', "blank.json": " \n",
                       "tail.json": '[{"id": 1}], 5', "braces.json": '[{"id": 1}'}.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = json_split.read_array_split(spark, str(tmp_path), "id long, text string")
        assert [r for r in got(df) if r[0] in texts] == sorted(want, key=repr)
        assert not [r for r in got(df) if r[0] not in texts]
        if size == "64":
            many = json_split.summaries(json_split.fragments(spark, str(tmp_path))).groupBy("path").agg(F.count("*").alias("n"))
            assert many.agg(F.max("n")).first()[0] > 10
        with pytest.raises(ValueError):
            json_split.read_array_split(spark, str(tmp_path), "id long", strict=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_the_same_rows_as_the_reader_of_whole_files(spark, tmp_path):
    rnd = random.Random(5)
    items, text = array(rnd, 200)
    (tmp_path / "a.json").write_text(text)
    schema = "id long, text string, more string"
    whole, split = (f(spark, str(tmp_path / "a.json"), schema, strict=True) for f in (json_docs.read_array, json_split.read_array_split))
    assert rows(split, "pos", "id", "text", "more") == rows(whole, "pos", "id", "text", "more")


def test_one_large_array_by_many_tasks(spark, tmp_path):
    """One file of 60 MB, an item of 9 MB in it: over forty ranges, positions without a gap, no range with over twice the median."""
    line = json.dumps({"id": 0, "text": 'a } "quoted" { [ brace' * 4, "tags": ["}", {"x": "]"}]})
    with open(tmp_path / "large.json", "w") as f:
        f.write("[")
        for i in range(380_000):
            f.write(("," if i else "") + line.replace('"id": 0', f'"id": {i}') if i != 200_000 else ', {"id": 200000, "text": "' + "} " * 4_500_000 + '"}')
        f.write("]")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        df = json_split.read_array_split(spark, str(tmp_path / "large.json"), "id long, text string")
        r = df.agg(F.count("*").alias("n"), F.count_if(F.col("pos") == F.col("id")).alias("same"), F.max(F.length("text")).alias("longest")).first()
        assert tuple(r) == (380_000, 380_000, 9_000_000)
        sizes = sorted(x["n"] for x in json_split.fragments(spark, str(tmp_path / "large.json")).groupBy("start").agg(F.sum(F.length("value")).alias("n")).collect())
        assert len(sizes) > 40 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
