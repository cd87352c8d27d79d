"""Token files, alignment of two tokenizers and centroid clustering against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from schemaloom.llm import alignment, clustering, token_files

ODD = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "\n", "a\r\nb", "a  b", "a   b", "a　b 　c", "x\x1c y\x1f z", "\x85 a", "don't DON'T 'S we'll.", "!'s.", "a.b,c;d",
       "H̱ ẖ KK ́x", "<|endoftext|>a <|ENDOFTEXT|> b<|startoftext|>", "Ünï ÇÖDÉ ﬁ Straße Σίσυφος ΑΣ", "😀👍🏽 é́ ", "日本語 テキスト。", "▁a ▁", "a▁b", "<s> </s> <unk> <0x41>",
       "tab\tx\t\ty", "1234 5.6% 7,8", "᠎ a ​ b﻿", "x" * 300, "a" + " " * 50 + "b", "...", "a...b ...c... ", "  a b", "\x00 a\x00b"]


def texts(seed: int = 1) -> list[tuple]:
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéßABC'") for _ in range(rnd.randint(1, 9))) + rnd.choice(["", "", "", ".", ",", "!?", ")."])
    rows = [(i * 3 + 1, rnd.choice([" ", " ", "\n"]).join(word() for _ in range(rnd.randint(1, 400)))) for i in range(40)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)]
    rows += [(None, "no id"), (None, None), (2, None), (5000, " ".join(word() for _ in range(20_000))), (5000, "same id"), rows[3], rows[3], (-5, "negative id")]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows, clashing=True):
    if not clashing:
        return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return spark.createDataFrame([(*r, 1, 2, "x", 3.0) for r in rows], "doc_id long, text string, row int, part int, h string, `n.a` double").repartition(5)


# --- token files ----------------------------------------------------------------------------------------------------

def specification(name):
    with open(token_files.vocabulary_file(name), encoding="utf-8") as f:
        return f.read()


def library_ids(name, values):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(token_files.vocabulary_file(name))
    return [e.ids + [1] for e in t.encode_batch([v or "" for v in values], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("length, file_ids", [(64, 3000), (2048, 1 << 22)])
def test_token_files(spark, name, length, file_ids):
    rows = texts()
    folder = token_files.workspace(spark) + "/tokens"
    token_files.write_tokens(frame(spark, rows), specification(name), folder, length=length, file_ids=file_ids)
    files = token_files.read_files(spark, folder)
    got = sorted(tuple(r) for r in ((r["start"], r["n_tokens"], r["ids_crc32"], -1 if r["doc_id"] is None else r["doc_id"]) for r in token_files.read_documents(files).collect()))
    want = {}
    for (i, _), ids in zip(rows, library_ids(name, [t for _, t in rows])):
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [(-1 if i is None else i) for i in sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))] == [g[3] for g in got]
    at = 0
    for start, n, _, _ in got:
        assert start == at
        at += n
    assert Counter((g[3], g[1], g[2]) for g in got) == Counter((-1 if i is None else i, *x) for i, xs in want.items() for x in xs)
    # sequences: all of one length, only the last of a file is padded, and the documents lie where the segments say
    flat = []
    for r in token_files.read_sequences(files).orderBy("part", "no", "k").collect():
        n = sum(r["mask"])
        assert len(r["ids"]) == len(r["mask"]) == length and r["mask"] == [True] * n + [False] * (length - n)
        assert [s["at"] for s in r["segments"]] == list(np.cumsum([0] + [s["n"] for s in r["segments"]])[:-1]) and sum(s["n"] for s in r["segments"]) == n
        flat += r["ids"][:n]
    assert len(flat) == at
    assert all(zlib.crc32(np.array(flat[s:s + n], "<u4").tobytes()) == c for s, n, c, _ in got)


def test_a_sequence_is_a_view_on_the_file(tmp_path):
    file = token_files.FileBuilder(np.dtype("<u2"), 3, 16)
    ids = np.arange(1000, dtype="<u2")
    file.add(7, ids[:30].tobytes())
    file.add(None, ids[30:].tobytes())
    raw = file.close()
    (tmp_path / "x.arrow").write_bytes(raw)
    with pa.memory_map(str(tmp_path / "x.arrow")) as f:
        reader = token_files.open_file(f)
        view, mask, segments = token_files.sequence(reader, 1)
        assert view.tolist() == list(range(16, 32)) and not view.flags.owndata and all(mask.to_pylist())
        assert segments == [{"doc_id": 7, "head": False, "at": 0, "n": 14}, {"doc_id": None, "head": True, "at": 14, "n": 2}]
        assert token_files.sequence(reader, 62)[1].to_pylist() == [True] * 8 + [False] * 8
    assert reader.schema.metadata[b"part"] == b"3" and file.offset == 1000


def test_words_are_remembered_in_two_generations(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 20)
    encoder = token_files.Encoder(specification("word_bpe_49k.json"))
    assert encoder.by_word
    values = [t or "" for _, t in texts(2)]
    for _ in range(2):
        got = [np.frombuffer(x, "<u2").tolist() + [1] for x in encoder.encode([v.encode() for v in values])]
        assert got == library_ids("word_bpe_49k.json", values)


# --- alignment ------------------------------------------------------------------------------------------------------

def spec():
    return alignment.read_spec(token_files.vocabulary_file("byte_bpe_50k.json"), token_files.vocabulary_file("piece_bpe_32k.model"))


def groups_by_hand(values):
    """Per text the groups as (A ids, B ids), by sets of ends of the whole text's tokens; None without tokens."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(token_files.vocabulary_file("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=token_files.vocabulary_file("piece_bpe_32k.model"))
    alphabet = {c: b for b, c in token_files.byte_alphabet().items()}
    out = []
    for text in values:
        if not text:
            out.append(None)
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ra = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ia]
        rb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ra) != (" " + text).encode() or b"".join(rb) != (" " + text).encode():
            out.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in ra]).tolist(), np.cumsum([len(x) for x in rb]).tolist()
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            i2, j2 = ea.index(e, i) + 1, eb.index(e, j) + 1
            groups.append((ia[i:i2], ib[j:j2]))
            i, j = i2, j2
        out.append(groups)
    return out


@pytest.mark.parametrize("heavy", [1, 200, 1 << 17])
def test_alignment(spark, heavy):
    rows = texts(3)
    groups = groups_by_hand([t for _, t in rows])
    count = Counter((g[0][-1], g[1][-1]) for gs in groups for g in gs or [])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    want = []
    for (i, _), gs in zip(rows, groups):
        pairs = [(g[0][-1], g[1][-1]) for g in gs or []]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs or [])
        want.append((i, sum(len(g[0]) for g in gs or []), sum(len(g[1]) for g in gs or []), len(pairs), len(pairs),
                     sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    got = alignment.alignment(frame(spark, rows), spec(), heavy=heavy)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_pieces_of_texts_have_the_tokens_of_the_whole(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    tokens = alignment.Tokens(spec())
    rnd = random.Random(4)
    values = [t for t in ODD if t] + ["".join(rnd.choice(["a", "b.", " ", "\n", " ", "　", "\x1c", "᠎", "é", "1", "'s", " "]) for _ in range(60)) for _ in range(300)]
    for text, groups, got in zip(values, groups_by_hand(values), [x for k in range(0, len(values), 7) for x in tokens.texts([v.encode() for v in values[k:k + 7]])]):
        assert (got is None) == (groups is None), text
        if got:
            assert [x.tolist() for x in got] == [[i for g in groups for i in g[k]] for k in (0, 1)], text
    assert list(tokens.texts([b"\xff", None, b""])) == [None] * 3
    assert tokens.parts and any(tokens._parts(p) for v in values for p in tokens.pieces(v))


def test_align_by_hand():
    rnd = random.Random(5)
    for _ in range(500):
        n = rnd.randint(1, 80)
        a = sorted({n, *rnd.sample(range(1, n + 1), rnd.randint(0, n))})
        b = sorted({n, *(a if rnd.random() < 0.5 else []), *rnd.sample(range(1, n + 1), rnd.randint(0, min(n, 5)))})
        inner_a, inner_b = alignment.align(a, b)
        assert inner_a == [i for i, x in enumerate(a) if x not in set(b)] and inner_b == [j for j, x in enumerate(b) if x not in set(a)]
    assert alignment.align([], []) == ([], [])


def test_long_stretches_take_few_comparisons():
    class Counted(list):
        n = 0

        def __getitem__(self, k):
            Counted.n += 1
            return list.__getitem__(self, k)
    ends = list(range(1, 100_001))
    assert alignment.align(Counted(ends), ends) == ([], []) and Counted.n < 60


# --- clustering -----------------------------------------------------------------------------------------------------

def clusters_by_hand(rows, k, rounds, dimensions):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            members = [v for (_, v), m in zip(kept, mine) if m == j]
            if members:
                centroids[j] = [sum(c) // len(members) for c in zip(*members)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


@pytest.mark.parametrize("dimensions, clusters, rounds, kind", [(64, 8, 10, "float"), (4, 20, 4, "double"), (2, 40, 3, "float"), (3, 500, 2, "float")])
def test_clustering(spark, dimensions, clusters, rounds, kind):
    """Coarse values bring ties; few dimensions bring equal vectors and empty clusters."""
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([-2, -1, -0.5, 0, 0.25, 1, 1.5]) if dimensions < 64 else rnd.gauss(0, 1) for _ in range(dimensions)]) for i in range(300)]
    rows += [(900, None), (901, []), (902, [1.0] * (dimensions - 1)), (903, [float("nan")] * dimensions), (904, [float("inf")] + [0.0] * (dimensions - 1)),
             (905, [None] + [0.0] * (dimensions - 1)), (906, [1000.0] * dimensions), (None, [0.5] * dimensions), (5, [0.25] * dimensions), rows[5], rows[5]]
    rows = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, v int, cluster string").repartition(4)
    got = clustering.cluster(df, clusters=clusters, rounds=rounds, dimensions=dimensions)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == clusters_by_hand(rows, clusters, rounds, dimensions)


def test_vectors_beyond_a_long_are_left_out(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [131071.0, -131071.0]), (3, [-131071.0, 131071.0])], "vec_id long, embedding array<double>")
    got = clustering.cluster(df, dimensions=2, clusters=1, rounds=1).collect()
    assert sorted(r["vec_id"] for r in got) == [2, 3] and all(r["distance"] >= 0 for r in got)


def test_the_tree_finds_the_nearest_and_prunes():
    rnd = np.random.default_rng(7)
    spots = rnd.integers(-10_000, 10_000, (40, 8))
    centroids = (spots[rnd.integers(0, 40, 300)] + rnd.integers(-50, 50, (300, 8))).astype(np.int64)
    centroids[17] = centroids[203]  # a tie in every search
    vectors = (centroids[rnd.integers(0, 300, 500)] + rnd.integers(-30, 30, (500, 8))).astype(np.int64)
    seen: list[int] = []
    who, best = clustering.nearest(vectors, centroids, clustering.build_tree(centroids), seen)
    all_ = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (best == all_.min(axis=1)).all() and (who == all_.argmin(axis=1)).all()
    assert sum(seen) < 0.5 * all_.size
    large = rnd.integers(-clustering.LARGEST + 1, clustering.LARGEST, (200, 64))
    who, best = clustering.nearest(large[100:], large[:100], clustering.build_tree(large[:100]))
    exact = [min((sum((int(x) - int(y)) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(large[:100])) for v in large[100:110]]
    assert [(int(d), int(j)) for d, j in zip(best[:10], who[:10])] == exact


def test_empty_tables(spark):
    none = frame(spark, [])
    assert token_files.round_trip(none, specification("word_bpe_49k.json")).count() == 0
    assert alignment.alignment(none, spec()).count() == 0
    assert clustering.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert token_files.round_trip(frame(spark, [(1, None)]), specification("word_bpe_49k.json")).collect()[0]["n_tokens"] == 1
