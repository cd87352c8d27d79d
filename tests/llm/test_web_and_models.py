"""WARC conversion, URL filter, language ID, SentencePiece and the pipeline."""

import base64
import gzip
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from schemaloom.llm import language_id, queries, sentencepiece_codec, simhash, url_filter, warc

SF = "/root/testdata/sf0.001"
has_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not there")


# --- archives -------------------------------------------------------------------------------------------------------

def test_round_trip_of_pages(spark):
    rnd = random.Random(1)
    html = ["", None, "a", "a", "WARC/1.1\r\n\r\n\r\nfiledesc://x 0 0 0 5\nURL", "é" * 50_000, "\r\n\r\n", "\n", "a", "x" * 3] + [f"p{rnd.random()}" for _ in range(40)]
    urls = ["http://a.org/x", None, "no scheme", "http://b c.org/\n\t", "", "http://ü.de/"]
    rows = [(i * 7 % 50, urls[i % 6], h, "t") for i, h in enumerate(html)] + [(3, "http://a.org/", "zz", "t"), (3, "http://a.org/", "zz", "t"), (None, "u", "a", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = sorted((tuple(r)[:5] for r in warc.archive_round_trip(pages, archive=2000).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    want, first = [], {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    done = set()
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        keep = i == first.get(h or "") and (i, h) not in done
        done.add((i, h))
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if keep else "revisit", None if keep else first[h or ""]))
    assert got == sorted(want, key=repr)


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(i, "http://a.org/", "abc" if i % 2 else "abcdef") for i in range(6)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(pages, least=4).collect()}
    assert got == {0: ("response", None), 2: ("revisit", 0), 4: ("revisit", 0), **dict.fromkeys((1, 3, 5), ("response", None))}


def test_both_versions_and_broken_archives():
    one = warc.arc_head(1) + b"\n" + warc.arc_record(1, "http://a/ b", "2001", "text/html", b"HTTP/1.0 200 OK\r\n\r\nhi\n\n") + b"\n"
    two = warc.arc_head(2) + b"\n" + warc.arc_record(2, "dns:a", "20010203040506", "text/dns", b"a IN A") + b"\n\n"
    a, b = list(warc.arc_records(one)), list(warc.arc_records(two))
    assert a[1]["content"].endswith(b"hi\n\n") and a[1]["url"] == "http://a/%20b" and a[1]["version"] == 1
    assert b[1]["version"] == 2 and b[1]["status"] == "200" and b[1]["content"] == b"a IN A"
    made = list(warc.warc_records(b"\r\n\r\n".join(warc.warc_record(r, None) for r in a + b)))
    assert [h["warc-type"] for h, _ in made] == ["warcinfo", "response", "warcinfo", "response"]
    assert made[1][0]["warc-date"] == "2001-01-01T00:00:00Z" and made[3][0]["warc-date"] == "2001-02-03T04:05:06Z"
    assert made[1][0]["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"hi\n\n").digest()).decode()
    for broken in (one[:-6], one.replace(b"text/html", b"text/html x"), b"nonsense\n"):
        with pytest.raises(ValueError):
            list(warc.arc_records(broken))
    assert list(warc.arc_records(warc._unzipped(gzip.compress(one)))) == a and not list(warc.arc_records(b""))


def test_pages_that_look_like_heads_and_revisits_without_length(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, "same") for i, u in enumerate(["filedesc://a", "filedesc:x", "http://a.org/"])], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["payload_bytes"], r["refers_to"], r["url"], r["intact"]) for r in warc.archive_round_trip(pages, archive=1).collect()}
    assert got == {0: ("response", 4, None, "filedesc://a", True), 1: ("revisit", 4, 0, "filedesc:x", True), 2: ("revisit", 4, 0, "http://a.org/", True)}
    foreign = warc.arc_head(2) + b"\n" + b"\n".join(warc.arc_record(2, f"http://{h}/", "2001", "text/html", b"HTTP/1.0 200 OK\r\n\r\nhello") for h in "ab") + b"\n"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "one.arc.gz").write_bytes(gzip.compress(foreign))
    files = warc.read_files(spark, str(tmp_path / "arc"))
    warc.convert(files, warc.revisits(warc.arc_index(files)), str(tmp_path / "warc"))
    read = warc.read_warcs(warc.read_files(spark, str(tmp_path / "warc"))).collect()
    assert sorted((r["record_type"], r["payload_bytes"], r["url"], r["intact"]) for r in read) == [("response", 5, "http://a/", True), ("revisit", 5, "http://b/", True)]


def test_no_pages(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- urls -----------------------------------------------------------------------------------------------------------

def test_hosts_paths_and_rules(spark):
    urls = {"http://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"), "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
            "x://org": ("org", "", None, "allow"), "x://org/": ("org", "/", "org/", "allow"), "http://forg/": ("forg", "/", None, "allow"),
            "http://a.com?x=://b.com/de/": ("a.com", "", None, "allow"), "http://a.com/de/://x": ("a.com", "/de/://x", "com/de/", "block"),
            "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "a://": ("", "", None, "allow"), "http://É.com/fr/\n/x": ("É.com", "/fr/\n/x", "com/fr/", "allow")}
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, n long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, labels).collect()}
    assert got == dict(enumerate(urls.values()))


def test_reputation_shrinks_and_blocks(spark):
    """A host with many bad pages is blocked, one with a single bad page is not, a new host takes after its domain."""
    pages, labels = [], []
    for h, n, bad in (("good.a.net", 200, 2), ("bad.a.net", 60, 55), ("once.a.net", 1, 1), ("x.farm.net", 50, 48), ("y.farm.net", 50, 50), ("z.farm.net", 50, 49),
                      *((f"h{i}.b{i % 5}.net", 40, i % 4) for i in range(40))):
        for k in range(n):
            pages.append((len(pages), f"http://{h}/p"))
            labels.append((len(pages) - 1, 0 if k < bad else 1, 0))
    labels += [(0, None, None), (0, 1, 0), (99_999, 0, 1), (None, 0, 1)]
    pages += [(len(pages), "http://new.farm.net/"), (len(pages) + 1, "http://new.a.net/"), (5, "http://good.a.net/p"), (None, "http://good.a.net/p")]
    got = url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.count() == len(pages)
    verdict = {r["host"]: r["verdict"] for r in got.collect()}
    assert {h for h, v in verdict.items() if v == "block"} == {"bad.a.net", "x.farm.net", "y.farm.net", "z.farm.net", "new.farm.net"}


def test_sites_suffixes_and_domains(spark):
    rows = {"h.net:8080": ("h.net", "net", "h.net"), "u:p@a.h.net:": ("a.h.net", "net", "h.net"), "x.co.uk": ("x.co.uk", "co.uk", "x.co.uk"), "a.x.co.uk.": ("a.x.co.uk", "co.uk", "x.co.uk"),
            "co.uk": ("co.uk", "co.uk", "co.uk"), "10.0.0.1:80": ("10.0.0.1",) * 3, "[::1]:8080": ("[::1]",) * 3, "1.2.3.4.5": ("1.2.3.4.5", "5", "4.5"), "localhost": ("localhost",) * 3, "": ("",) * 3}
    site = url_filter.site_of(F.col("host"))
    got = spark.createDataFrame([(h,) for h in rows], "host string").select("host", site.alias("site")).select("host", "site", *url_filter.suffix_and_domain(F.col("site"))).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == rows


def test_strangers_do_not_share_a_verdict(spark):
    """Forty bad pages of one host say nothing of another under the same public suffix or in the same network."""
    urls = [f"http://{h}/" for h in ("a.co.uk", "10.0.0.1", "a.github.io") for _ in range(40)] + ["http://b.co.uk/", "http://9.8.0.1/", "http://b.github.io", "http://c.uk/",
            "http://w.a.co.uk:81/", "http://me@10.0.0.1:8080/x"] + ["http://good.org/"] * 15
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 120 else 1, 0) for i, u in enumerate(urls) if i < 120 or "good" in u], "doc_id long, quality int, toxic int")
    got = {r["host"]: r["verdict"] for r in url_filter.url_filter(pages, labels).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"a.co.uk", "10.0.0.1", "a.github.io", "w.a.co.uk:81", "me@10.0.0.1:8080"}


def test_no_urls(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.url_filter(none, spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")).count() == 0


# --- languages ------------------------------------------------------------------------------------------------------

def test_word_scores_are_the_models_probabilities():
    """Probabilities of all characters after a context add up to one, and the arrays give what the formula gives."""
    rnd = random.Random(2)
    words = {"x": ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6))) for _ in range(200)],
             "y": ["".join(rnd.choice("cdef") for _ in range(rnd.randint(1, 6))) for _ in range(100)]}
    counts, order = {}, 3
    for lang, ws in words.items():
        top = {}
        for w in ws:
            p = language_id.EDGE * (order - 1) + w + language_id.EDGE
            for i in range(len(p) - order + 1):
                top[p[i:i + order]] = top.get(p[i:i + order], 0) + 1
        here = top
        for k in range(order, 0, -1):
            counts |= {(k, lang, g): n for g, n in here.items()}
            lower = {}
            for g in here:
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            here = lower
    model = language_id.fit([(k, l, g, n) for (k, l, g), n in counts.items()], ["x", "y"], order)
    alphabet = len({g for k, _, g in counts if k == 1}) + 1

    def p(lang, gram):
        k = len(gram)
        mine = {g: n for (kk, l, g), n in counts.items() if kk == k and l == lang}
        ones, twos = sum(n == 1 for n in mine.values()), sum(n == 2 for n in mine.values())
        d = min(0.9, max(0.1, ones / (ones + 2 * twos) if ones + twos else 0.5))
        after = {g: n for g, n in mine.items() if g[:-1] == gram[:-1]}
        below = p(lang, gram[1:]) if k > 1 else 1 / alphabet
        if not after:
            return below
        return max(mine.get(gram, 0) - d, 0) / sum(after.values()) + d * len(after) / sum(after.values()) * below
    got = language_id.word_scores(model, ["ab", "", "zz", "cdcd", "b"])
    for row, w in zip(got, ["ab", "", "zz", "cdcd", "b"]):
        padded = language_id.EDGE * (order - 1) + w + language_id.EDGE
        want = [sum(np.log(p(l, padded[i:i + order])) for i in range(len(w) + 1)) if w else 0 for l in ("x", "y")]
        assert np.allclose(row, [len(w) + 1 if w else 0, *want])
    chars = sorted({g for k, _, g in counts if k == 1})
    assert sum(p("x", "ab" + c) for c in chars) + p("x", "ab" + "?") == pytest.approx(1)


@has_tables
def test_languages_of_held_out_documents(spark):
    got = queries.op6_language_id(spark, SF).join(queries.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got) and sum(r["rejected"] for r in got) <= 0.01 * len(got)


@has_tables
def test_odd_texts(spark):
    docs = queries.table(spark, SF, "documents")
    model = language_id.train(docs)
    rows = [(1, None), (2, ""), (3, "123 !? _"), (4, "the " * 50_000), (5, "ξψφ ωθδ λκρ " * 50), (6, "É"), (None, "was the of in"), (6, "É")]
    odd = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    got = [(r["doc_id"], r["lang_pred"], r["rejected"]) for r in language_id.identify(odd, model).collect()]
    assert len(got) == len(rows)
    assert {g for g in got if g[0] in (1, 2, 3)} == {(i, "und", True) for i in (1, 2, 3)}
    assert (4, "en", False) in got and [g[2] for g in got if g[0] == 5] == [True]
    assert {r["doc_id"] for r in language_id.kept(odd, model).collect()} >= {4, 6, None}
    empty = language_id.train(docs.limit(0))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(odd, empty).collect()} == {("und", 0.0)}
    assert language_id.identify(odd.limit(0), model).count() == 0


@has_tables
def test_short_texts_in_other_languages_are_rejected(spark):
    """Of pieces of held-out documents, some words long, hardly any; of languages and letters without a model, all."""
    docs = queries.table(spark, SF, "documents").where("lang IS NOT NULL AND text IS NOT NULL")
    model = language_id.train(docs.where(~language_id.in_fold(F.col("doc_id"))))
    foreign = ["oggi il tempo è molto bello", "il gatto dorme sul divano rosso", "xqzvk wprtl jjkqz mnbvc ghtyw", "sabah erken kalkmak iyidir",
               "Доброе утро, как ваши дела", "今天天气很好我们去公园散步吧", "hyvää huomenta kaikille"]
    assert all(sum(c.isalpha() for c in t) < 40 for t in foreign)
    texts = [r["text"] for r in docs.where(language_id.in_fold(F.col("doc_id"))).limit(150).collect()]
    own = [" ".join(t.split()[2:2 + k]) for t in texts for k in (3, 6, 12, 40, 10**6) if len(t.split()) > 2 + k]
    both = spark.createDataFrame([(i, t) for i, t in enumerate(foreign + own)], "doc_id long, text string")
    got = {r["doc_id"]: r["rejected"] for r in language_id.identify(both, model).collect()}
    assert all(got[i] for i in range(len(foreign)))
    assert sum(got[i] for i in range(len(foreign), len(got))) <= 0.03 * len(own)


def test_scores_and_limits_by_hand():
    """score: odds under the sharpness; limit: the stated quantile of the pieces' deviations."""
    counts = [(k, l, g, 3) for l, letters in (("x", "ab"), ("y", "cd")) for k in (1, 2) for g in ([*letters, language_id.EDGE] if k == 1 else [letters, letters[::-1], language_id.EDGE + letters[0], letters[1] + language_id.EDGE])]
    model = language_id.fit(counts, ["x", "y"], 2)
    held = [("x", "ab abab ab " * 30), ("x", "abab ab ba " * 20), ("y", "cdcd cd " * 25)]
    language_id.calibrate(model, held)
    scorer = language_id.Scorer(model)
    sums = scorer.texts(["ab ab", "cd", "zz", None, "²"])
    best, score, z = language_id.judge(model, sums)
    assert best.tolist()[:2] == [0, 1] and best.tolist()[3:] == [-1, -1] and score.tolist()[3:] == [0, 0]
    for k in range(3):
        h = -sums[k, 1:] / sums[k, 0]
        odds = np.exp(-model.sharpness * (h - h.min()))
        assert score[k] == pytest.approx(1 / odds.sum())
        l = best[k]
        assert z[k] == pytest.approx((h[l] - model.mean[l] - model.slack[l]) / np.sqrt(model.between[l] + model.within[l] / sums[k, 0]))
    assert language_id._rejected(model, best, z).tolist() == [False, False, bool(z[2] > model.limit[best[2]]), True, True]
    other = -scorer.texts([held[2][1]])[0]
    assert model.slack[0] == pytest.approx(language_id.FOREIGN * (other[1] / -other[0] - model.mean[0]))
    rows = scorer.runs("ab abab x²y")
    assert rows[:, 0].tolist() == [3, 5, 4] and language_id.words_of("x²y") == ["x", "y"]  # with the end marks
    assert sorted(language_id.pieces(rows, (4,))[:, 0].tolist()) == [4, 8, 12]


# --- pieces ---------------------------------------------------------------------------------------------------------

TEXTS = ["", " ", "  lead and   runs     of spaces ", "a\n\n\tb\r\n", "▁", "a▁b ▁▁ c", "Ünïcödé 😀 漢字 \u0300", "x" * 5000, "aaaa aaab abab", "\x00\x01", "<0x0A><s></s>", "hello world, this is a test."]


@pytest.mark.skipif(not os.path.exists(sentencepiece_codec.MODEL), reason="no tokenizer file")
def test_same_ids_as_the_library(spark):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_vocabulary())
    rnd = random.Random(3)
    texts = TEXTS + ["".join(rnd.choice("  abcdeéinrst.\n▁😀0") for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        assert codec.decode(codec.encode(t)) == t
        if "▁" not in t:  # the library reads that mark as a space
            assert codec.encode(t) == lib.encode(t), t


@pytest.mark.skipif(not os.path.exists(sentencepiece_codec.MODEL), reason="no tokenizer file")
def test_encode_and_decode_frames(spark):
    rows = [(i, t, [1], "d") for i, t in enumerate([*TEXTS, None, "word " * 30_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, decoded string")
    v = sentencepiece_codec.read_vocabulary()
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, v), v)
    assert back.columns == ["doc_id", "text", "ids", "decoded"]
    assert all(r["text"] == r["decoded"] and (r["ids"] is None) == (r["text"] is None) for r in back.collect())
    assert sentencepiece_codec.encode(docs.limit(0), v).count() == 0


@pytest.mark.skipif(not os.path.exists(sentencepiece_codec.MODEL), reason="no tokenizer file")
def test_a_round_trip_is_one_pass_and_words_are_remembered_without_marks(spark):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    v = sentencepiece_codec.read_vocabulary()
    codec = sentencepiece_codec.Codec(v)
    texts = ["Wqord, Wqord. Wqord", "élan; 3.5 e.g. a.b,c!? x:\n(y).", ".com .. a", "I.B.M.'s", "word." * 40]
    assert [codec.encode(t) for t in texts] == [lib.encode(t) for t in texts]
    assert f"{sentencepiece_codec.SPACE}Wqord" in codec.seen and f"{sentencepiece_codec.SPACE}Wqord," not in codec.seen
    docs = spark.createDataFrame([*enumerate([*texts, "", None])], "doc_id long, text string")
    trip = sentencepiece_codec.round_trip(docs, v)
    assert trip._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [tuple(r) for r in trip.orderBy("doc_id").collect()] == [
        *((k, lib.encode(t), len(lib.encode(t)), t) for k, t in enumerate([*texts, ""])), (len(texts) + 1, None, 0, None)]


def test_unigram_segmentation_has_the_best_score():
    rnd = random.Random(4)
    pieces = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(40)} - {"c"})
    scores = [-rnd.uniform(1, 6) for _ in pieces]
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary(["<unk>", *pieces], [0.0, *scores], ["unknown", *["normal"] * len(pieces)], False, False))
    score = dict(zip(pieces, scores))
    for _ in range(200):
        text = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))

        def best(t):
            return 0.0 if not t else max((s + best(t[len(p):]) for p, s in [*score.items(), ("c", codec.floor)] if t.startswith(p)), default=-1e9)
        assert sum(score.get(p, codec.floor) for p in codec._segment(text)) == pytest.approx(best(text))


@pytest.mark.skipif(not os.path.exists(sentencepiece_codec.MODEL), reason="no tokenizer file")
def test_unigram_of_a_real_size():
    """The 32,000 pieces with scores of their own as a unigram model: the pass finds the best sum that a plain table finds."""
    v = sentencepiece_codec.read_vocabulary()
    assert v.bpe and v.dummy_prefix
    rnd = random.Random(8)
    scores = [-rnd.uniform(3, 14) - 0.5 * len(p) for p in v.pieces]
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary(v.pieces, scores, v.kinds, False, True))
    of = {p: scores[i] for p, i in codec.ids.items()}
    longest = max(map(len, of))
    words = [p.strip("▁") for p in rnd.sample(v.pieces, 400)]
    for _ in range(300):
        text = " ".join(rnd.choice(words) + rnd.choice(["", "ing", "漢", "😀", "."]) for _ in range(rnd.randint(1, 12)))
        unit = ("▁" + text.replace(" ", "▁"))
        best = [0.0] + [-1e18] * len(unit)
        for end in range(1, len(unit) + 1):
            for start in range(max(0, end - longest), end):
                s = of.get(unit[start:end], codec.floor if end - start == 1 else None)
                if s is not None:
                    best[end] = max(best[end], best[start] + s)
        ids = codec.encode(text)
        assert codec.decode(ids) == text
        assert sum(of.get(p, codec.floor) for p in codec._segment(unit)) == pytest.approx(best[-1])
        parts = [p for u in codec.units.findall(unit) for p in codec._segment(u)]
        assert sum(of.get(p, codec.floor) for p in parts) == pytest.approx(best[-1])  # units cut where no piece reaches across
        assert [i for p in parts for i in ([codec.ids[p]] if p in codec.ids else codec._fallback(p))] == ids


def test_only_models_that_leave_texts_alone_are_read(monkeypatch):
    import sentencepiece
    assert list(sentencepiece_codec._fields(bytes([8, 150, 1, 18, 2, 65, 66, 29, 0, 0, 0, 0]))) == [(1, 150), (2, b"AB"), (3, bytes(4))]
    for trainer, normalizer in ((b"\x18\x03", b"\x20\x00"), (b"\x18\x02", b""), (b"\x18\x02", b"\x12\x01x\x20\x00")):
        raw = bytes([18, len(trainer)]) + trainer + bytes([26, len(normalizer)]) + normalizer
        fake = type("M", (), {"__init__": lambda self, model_file: None, "serialized_model_proto": lambda self, raw=raw: raw})
        monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", fake)
        with pytest.raises(ValueError):
            sentencepiece_codec.read_vocabulary("x")


# --- pipeline -------------------------------------------------------------------------------------------------------

@has_tables
def test_pipeline_stages(spark):
    docs = queries.table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "mixing", "sentencepiece"]
    odd = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "", "en", None, 0), (9003, "123", None, "src1", 3), (9004, "x", "en", "src1", 1), (9004, "x", "en", "src1", 1)],
                                docs.schema)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs.unionByName(odd) if not seen else docs, SF))
        seen[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not {9001, 9002, 9003} & {r["doc_id"] for r in seen["language_id"]}
    # line dedup keeps every document
    assert sorted(r["doc_id"] for r in seen["line_dedup"]) == sorted(r["doc_id"] for r in seen["language_id"])
    # one of each group, by brute force
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in seen["line_dedup"]}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in seen["simhash"]) == sorted({find(i) for i in prints})
    # the mixture: at most the budget, less one document a leaf
    tokens = sum(len((r["text"] or "").split()) for r in seen["simhash"])
    mixed = sum(len((r["text"] or "").split()) for r in seen["mixing"])
    assert 0.5 * tokens < mixed <= 0.8 * tokens
    assert {(r["doc_id"], r["text"]) for r in seen["mixing"]} <= {(r["doc_id"], r["text"]) for r in seen["simhash"]}
    text = {r["doc_id"]: r["text"] for r in seen["mixing"]}
    assert {r["doc_id"]: r["decoded"] for r in seen["sentencepiece"]} == text


def test_one_document_of_each_group(spark):
    """Groups without ids, groups that share their least id, and a group of rows with and without an id."""
    rnd = random.Random(21)
    a, b, c, d, e, f = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(80)) for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (7, d.upper()), (None, e), (9, e.upper()), (8, e), (8, e), (2, f), (2, f.upper())]
    prints = [simhash.fingerprint(t) for _, t in rows]
    assert all((x == y) == ((x ^ y).bit_count() <= 2) for x in prints for y in prints) and len(set(prints)) == 6
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
    last = [r for r in got if r[0] == 2]  # an id with two texts in one group: either, but one
    assert len(last) == 1 and last[0][1] in (f, f.upper())
    assert sorted((r for r in got if r[0] != 2), key=repr) == sorted([(None, a), (None, b), (1, c), (1, d), (8, e)], key=repr)


@has_tables
def test_pipeline_of_nothing(spark, tmp_path):
    queries.table(spark, SF, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@has_tables
def test_native_queries_use_no_python(spark):
    for name in ("op1_line_dedup", "op2_quality_rules", "op5_url_filter", "op9_mixing"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoop")), name


@has_tables
def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
    F  # noqa: B018
