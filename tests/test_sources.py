import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from schemaloom.operators import catalog
from schemaloom.plans import flows
from schemaloom.sources import descriptions, encodings, json_docs, sinks


def test_encodings(spark, tmp_path):
    files = {"plain": "naïve €".encode(), "mark": "\ufeffnaïve".encode(), "windows": "naïve €".encode("cp1252"),
             "latin": b"na\xefve \x81", "ascii": b"abc"}
    for name, content in files.items():
        (tmp_path / f"{name}.txt").write_bytes(content)
    got = {p.rsplit("/", 1)[1][:-4]: t for p, t in rows(encodings.read_texts(spark, str(tmp_path)))}
    assert got == {"plain": "naïve €", "mark": "naïve", "windows": "naïve €", "latin": "naïve \x81", "ascii": "abc"}


def test_json_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text("\ufeff " + json.dumps([{"q": "één"}, {"n": 2}], ensure_ascii=False), "utf-8")
    read = lambda f, **kw: json_docs.read_array(spark, str(tmp_path / f), "q string, n int", **kw)
    assert rows(read("a.json"), "pos", "q", "n") == [(0, "één", None), (1, None, 2)]
    (tmp_path / "o.json").write_text('{"q": "x"}')
    assert read("o.json").count() == 0
    with pytest.raises(Exception, match="expected a JSON array"):
        read("o.json", strict=True).collect()
    assert json_docs.read_questions(spark, str(tmp_path / "none.json")).count() == 0


def test_folders(spark):
    f = spark.createDataFrame([(0, "my-db"), (0, "My_DB"), (1, "mydb"), (1, "other"), (1, "数据")], "root_ord int, folder string")
    dbs = spark.createDataFrame([("mydb",), ("other",), ("none",), ("My_DB",), ("数",)], "db_id string")
    assert rows(descriptions.resolve_folders(dbs, f)) == [
            ("My_DB", 0, "My_DB"), ("mydb", 0, "My_DB"), ("other", 1, "other"), ("数", 1, "数据")]


def test_shared_folder_comes_from_the_session(spark):
    assert sinks.shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_jobs_from_files_to_files(spark, tmp_path):
    """Description files, enrichment, graphs, chunks and merge over one small set of files."""
    schema = {"db_id": "shop 1", "table_names": ["client list", "town"], "table_names_original": ["clients", "town"],
              "column_names": [[-1, "*"], [0, "id"], [0, "town id"], [1, "id"]],
              "column_names_original": [[-1, "*"], [0, "id"], [0, "town_id"], [1, "id"]], "foreign_keys": [[2, 3]],
              "primary_keys": [1, [2, 3]], "x": {"y": None, "z": "a \"b\" }"}}
    (tmp_path / "tables.json").write_text(json.dumps([schema]))
    d = tmp_path / "dbs" / "Shop_1" / "database_description"
    d.mkdir(parents=True)
    (d / "clients.csv").write_bytes('original_column_name,column_name,column_description\r\n'
                                    'TOWN_ID,town,"where, they\r\nlive “now”"\r\n'.encode("cp1252"))
    (d / "town.csv").write_text("\ufefforiginal,description,extra\nid,town id,x\n", "utf-8")
    questions = [{"question_id": i, "db_id": db, "question": f"q{i}", "evidence": "", "SQL": sql, "difficulty": "simple", "topic": ["t", 1.5]}
                 for i, (db, sql) in enumerate([
                     ("shop 1", "SELECT 1 FROM clients c JOIN town t ON c.town_id = t.id"), ("gone", "SELECT 1"),
                     ("shop 1", "SELECT 1 FROM Town"), ("shop 1", "")])]
    (tmp_path / "q.json").write_text(json.dumps(questions))

    report = flows.enrich_schemas(spark, str(tmp_path / "tables.json"), [str(tmp_path / "dbs")], str(tmp_path / "out"))
    assert rows(report) == [(1, 0, 1, 0)]
    done = spark.read.json(str(tmp_path / "out")).first()
    assert done["column_descriptions"] == ["", "", "where, they\r\nlive “now”", "town id"]
    summary = "clients.town_id references town.id. where, they live “now”."
    assert done["foreign_key_descriptions"][0]["summary"] == summary
    written = [json.loads(x) for x in (r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())]
    assert [{k: e[k] for k in schema} for e in written] == [schema]
    assert set(written[0]) == {*schema, "column_descriptions", "foreign_key_descriptions"}

    flows.build_gold_graphs(spark, str(tmp_path / "tables.json"), [str(tmp_path / "dbs")],
                            [str(tmp_path / "q.json"), str(tmp_path / "missing.json")], str(tmp_path / "gold"))
    gold = sorted(spark.read.json(str(tmp_path / "gold")).collect(), key=lambda r: r["record_key"])
    assert [r["record_key"] for r in gold] == [0, 2, 3]
    assert gold[0]["context_text"].endswith(f"Relationships:\nclients.town_id → town.id ({summary})")
    assert gold[1]["context_text"] == "Table Town: id: town id" and gold[2]["context_text"] == ""

    # the enriched file alone, as it was written and as an array, gives the same
    (tmp_path / "enriched.json").write_text(json.dumps(written))
    for enriched in ("out", "enriched.json"):
        flows.build_gold_graphs(spark, str(tmp_path / enriched), None, [str(tmp_path / "q.json")], str(tmp_path / "gold2"))
        assert sorted(spark.read.json(str(tmp_path / "gold2")).collect(), key=lambda r: r["record_key"]) == gold

    report = flows.prepare_translation(spark, str(tmp_path / "q.json"), str(tmp_path / "parts"), "q", 3).first()
    assert (report["records"], report["changed"]) == (4, 4)
    names = sorted(p.name for p in (tmp_path / "parts").iterdir() if p.is_dir())
    assert names == ["chunk=q_part1of3", "chunk=q_part2of3", "chunk=q_part3of3"]
    out = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "parts")).collect()]
    assert len(out) == 4 and all(r["topic"] == ["t", 1.5] and "pos" not in r and "idx" not in r for r in out)


def test_chunks_without_rows_are_written(spark, tmp_path):
    one = spark.createDataFrame([(1, "a", 1)], "id int, s string, part int")
    sinks.write_chunks(one, str(tmp_path / "c"), "q", 3)
    assert sorted(p.name for p in (tmp_path / "c").iterdir() if p.is_dir()) == [f"chunk=q_part{i}of3" for i in (1, 2, 3)]
    assert rows(sinks.read_chunks(spark, str(tmp_path / "c"), "id int, s string")) == [(1, "a", "q_part1of3")]


def test_cells_of_any_length(spark):
    texts = spark.createDataFrame([("x/d/database_description/t.csv", "original_column_name\n" + "a" * 200_000 + "\n"),
                                   ("x/d/database_description/u.csv", "original_column_name\nid\n")], "path string, text string")
    got = descriptions.parse_files(texts)
    assert got.filter("error is not null").count() == 0
    assert sorted(len(r["original_column_name"]) for r in got.collect()) == [2, 200_000]


def test_one_bad_item_or_key_takes_nothing_else_with_it(spark, tmp_path):
    (tmp_path / "i.json").write_text('[1, {"q": "a"}, null, "x", {"q": "b", "n": "no number"}]')
    assert rows(json_docs.read_array(spark, str(tmp_path / "i.json"), "q string, n int"), "pos", "q", "n") == [(1, "a", None), (4, "b", None)]
    (tmp_path / "cut.json").write_text('[{"q": "a"}, {"q"')
    with pytest.raises(Exception, match="expected a JSON array"):
        json_docs.read_array(spark, str(tmp_path / "cut.json"), "q string", strict=True).collect()
    (tmp_path / "e.json").write_text('[{"db_id": "d", "foreign_keys": [[1, 2], ["x", 3], [[1, 2], 3], 7, [4, 5]]}]')
    assert json_docs.read_entries(spark, str(tmp_path / "e.json")).first()["foreign_keys"] == [[1, 2], [None, 3], [None, 3], None, [4, 5]]


def test_entries_are_written_back_by_their_place(spark, tmp_path):
    """Repeated entries each with their own columns, entries without an id as they were, the order of the file."""
    entry = lambda db, *cols, **more: {"db_id": db, "table_names_original": ["t"], "column_names_original": [[-1, "*"], *([0, c] for c in cols)], "foreign_keys": [], **more}
    nameless = {"table_names_original": ["x"], "z": [1, {"y": None}]}
    items = [entry("d", "a"), nameless, entry("d", "a", "b", extra=1), {"db_id": ""}, entry("e", "a"), {"db_id": None, "q": "ü"}, {"db_id": "bare"}]
    (tmp_path / "s.json").write_text(json.dumps(items))
    d = tmp_path / "dbs" / "d" / "database_description"
    d.mkdir(parents=True)
    (d / "t.csv").write_text("original_column_name,column_description\na,first\nb,second\n")
    report = flows.enrich_schemas(spark, str(tmp_path / "s.json"), [str(tmp_path / "dbs")], str(tmp_path / "out"))
    out = [json.loads(line) for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    texts = [["", "first"], None, ["", "first", "second"], None, ["", ""], None, []]
    assert out == [item if t is None else {"column_descriptions": t, "foreign_key_descriptions": [], **item} for item, t in zip(items, texts)]
    assert rows(report) == [(4, 0, 1, 0)]
    last = catalog.latest_entries(catalog.named_entries(flows.read_enriched(spark, str(tmp_path / "out"))), "pos")
    assert rows(last.select("db_id", F.array_join("column_descriptions", ","))) == [("bare", ""), ("d", ",first,second"), ("e", ",")]


def test_an_empty_folder_hides_a_later_root(spark, tmp_path):
    for root, db in (("one", "Shop-1"), ("two", "shop1"), ("two", "other")):
        (tmp_path / root / db / "database_description").mkdir(parents=True)
    for db in ("shop1", "other"):
        (tmp_path / "two" / db / "database_description" / "t.csv").write_text("original_column_name,column_description\na,text\n")
    (tmp_path / "one" / "file").write_text("no folder")
    roots = [str(tmp_path / r) for r in ("one", "two", "three")]
    assert rows(descriptions.list_folders(spark, roots)) == [(0, "Shop-1"), (1, "other"), (1, "shop1")]
    dbs = spark.createDataFrame([("shop1",), ("other",)], "db_id string")
    assert rows(flows.description_rows(spark, dbs, roots), "db_id", "column_description") == [("other", "text")]
    assert rows(descriptions.descriptions_by_db(dbs, descriptions.read_description_files(spark, roots[1:2])), "db_id") == [("other",), ("shop1",)]


def test_small_description_files_share_a_frame():
    import pandas as pd
    texts = ["original_column_name,column_description\r\na,one\r\nb,two", "original_column_name\r\n", ""] * 1000
    frames = list(descriptions._parse([pd.DataFrame({"path": [str(i) for i in range(3000)], "text": texts})]))
    assert len(frames) < 10 and sum(map(len, frames)) == 2000
    assert frames[0].iloc[1].tolist()[:3] == ["0", 1, "b"] and str(frames[0]["row_no"].dtype) == "Int32"
