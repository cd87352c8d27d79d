"""All rows of the pipeline against brute force, stage by stage without Spark, and odd column names."""

import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import components_by_hand, fingerprint_by_hand, lines_by_hand

import corpus_pipeline
from schemaloom.llm import language_id, line_dedup, mixing, queries, sentencepiece_codec

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not there")


def accepted_by_hand(model, text):
    """Is the text's cross-entropy under its best language within that language's limit? Word by word, from the model's arrays."""
    words = [w for run in re.findall(r"[^\W\d_]+", text or "") for w in language_id.words_of(run)]
    if not words:
        return False
    rows = np.array([language_id.word_scores(model, [w])[0] for w in words]).sum(axis=0)
    h = -rows[1:] / rows[0]
    l = int(h.argmin())
    return (h[l] - model.mean[l] - model.slack[l]) / np.sqrt(model.between[l] + model.within[l] / rows[0]) <= model.limit[l]


def shares_by_hand(budget, children):
    """{name: (capacity, weight)} to {name: budget}: full ones first, the rest by weight with cumulative rounding."""
    out, left, weights, rest = {}, budget, sum(w for _, w in children.values()), None
    for name, (capacity, weight) in sorted(children.items(), key=lambda c: (c[1][0] / c[1][1], c[0])):
        if rest is None and capacity * weights <= left * weight:
            out[name] = capacity
            left, weights = left - capacity, weights - weight
            continue
        if rest is None:
            rest, open_, upto = left, weights, 0
        out[name] = rest * (upto + weight) // open_ - rest * upto // open_
        upto += weight
    return out


def chosen_by_hand(docs):
    """Ids that the mixture takes: 80 % of the tokens down the tree, then a seeded prefix of each leaf. docs: (id, text, lang, source)."""
    def domain(source):
        n = re.search(r"(\d{1,9})$", source or "")
        return {0: "web", 1: "news", 2: "books"}[int(n[1]) % 3] if n else "none"

    leaves = {}
    for i, text, lang, source in docs:
        leaves.setdefault((domain(source), lang or "none", source or "none"), []).append((i, len(WORDS.findall(text))))
    size = {k: sum(n for _, n in v) for k, v in leaves.items()}
    weight = lambda level, name: queries.WEIGHTS.get(level, {}).get(name, 1)
    out, total = set(), sum(size.values())
    under = lambda head: {k[len(head)] for k in size if k[:len(head)] == head}
    cap = lambda head: sum(n for k, n in size.items() if k[:len(head)] == head)

    def down(head, budget):
        if len(head) < 3:
            level = mixing.LEVELS[len(head)]
            for name, part in shares_by_hand(budget, {x: (cap((*head, x)), weight(level, x)) for x in under(head)}).items():
                down((*head, name), part)
            return
        epochs, rest = divmod(budget, size[head]) if size[head] else (0, 0)
        used = 0
        for i, n in sorted(leaves[head], key=lambda d: hashlib.md5(f"42:{epochs}:{d[0]}".encode()).hexdigest()):
            used += n
            if epochs or rest and used <= rest:
                out.add(i)

    down((), total * 80 // 100)
    return out


def test_every_row_of_the_pipeline(spark, tmp_path):
    import sentencepiece
    docs = queries.table(spark, SF, "documents")
    licence = "All rights reserved. No part may be copied."
    odd = [(9001, None, "en", "src1"), (9002, "", "en", None), (9003, "123", None, "src1"), (9005, "oggi il tempo è molto bello e andiamo al mare", "en", "src2"),
           *((9100 + k, f"The edea be esinti eses the in aton thonre was {k} is anly hend and oftionnten.\n{licence}\nThe ofha {'and ' * k}", "en", f"src{k}") for k in range(14))]
    docs = docs.unionByName(spark.createDataFrame([(*r, len(r[1] or "")) for r in odd], docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    model = language_id.train(docs.where(~language_id.in_fold(F.col("doc_id"))))
    rows = [r for r in rows if accepted_by_hand(model, r[1])]
    assert not {9001, 9002, 9003, 9005} & {r[0] for r in rows}
    without = {i: text for i, text, _, _ in lines_by_hand(rows, line_dedup.MIN_SITES)}
    assert sum(licence in t for t in without.values()) == 1
    rows = [(i, without[i], lang, source) for i, _, lang, source in rows]
    prints = [fingerprint_by_hand(r[1]) for r in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = components_by_hand(near, range(len(rows)))
    least = {}
    for k, r in enumerate(rows):
        least[root[k]] = min(r[0], least.get(root[k], r[0]))
    rows = [r for r in rows if r[0] in set(least.values())]
    chosen = chosen_by_hand(rows)
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    want = sorted((i, lib.encode(text), text) for i, text, _, _ in rows if i in chosen)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], list(r["ids"]), r["decoded"]) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got) and 50 < len(got) < len(rows)


def test_columns_with_a_dot(spark):
    docs = spark.createDataFrame([(1, "the in of\nline", "en", "src1", 5, 0.5), (2, "", None, None, 0, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long, `odd.name` double")
    assert line_dedup.line_dedup(docs).columns[:6] == docs.columns
    v = sentencepiece_codec.read_vocabulary()
    assert sentencepiece_codec.encode(docs, v).columns == [*docs.columns, "ids"]
    assert [r["odd.name"] for r in sentencepiece_codec.encode(docs, v).orderBy("doc_id").collect()] == [0.5, None]
    assert language_id.kept(docs, language_id.train(docs)).columns == docs.columns
    chosen = mixing.mix_sources(docs, F.lit("a"), F.col("lang"), F.col("source"), mixing.n_words(F.col("text")), {})
    assert mixing.mixed(docs, chosen).columns == docs.columns
    assert corpus_pipeline.one_of_each(spark, docs, "").columns == docs.columns


def test_workers_find_the_package_wherever_the_driver_was_started(tmp_path):
    """A driver in another folder, with the package on its own path only."""
    import subprocess
    import sys
    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    script = f"""
import sys; sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as E
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
print("rows", E.queries()["op4_simhash"](spark, {SF!r}).count(), E.queries()["description_csv"](spark, {SF!r}).count() > 0)
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200 True" in done.stdout, done.stderr[-2000:]
