"""Line dedup, quality rules, SimHash, substring dedup, mixing and exact dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom.llm import exact_dedup, line_dedup, mixing, quality, simhash, substring_dedup
from schemaloom.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "doc_id long, text string, lang string, source string, n long, pos int, h1 long, kept boolean, words string, fp long"


def made(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, common lines and passages, odd words, nulls and repeated rows."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 4)))
    passage = " ".join(word() for _ in range(70))
    out = []
    for i in range(n):
        text = "\n".join(" ".join(word() for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 8)))
        if i % 3 == 0:
            text += "\nAll rights reserved. \r\n"
        if i % 5 == 0:
            text = f"{text} {passage}\n{text[:10]}"
        if out and i % 7 == 0 and out[-1][1]:
            text = out[rnd.randrange(len(out))][1] or ""
            text = text.upper() if i % 2 else text + " x"
        out.append((i * 3 + 1, text, rnd.choice(["en", "de", None]), f"src{i % 13}" if i % 11 else None))
    out += [(500, None, None, None), (501, "", "en", "src1"), (502, " \t\n\x0b ", "en", "src1"), (503, "one", "en", "src2"), (504, "two words", "fr", "src0"),
            (505, "same " * 300, "en", "src3"), (506, "\x85 \xa0 a　b", "en", "src3"), (None, "no id", "en", "src3"),
            (507, " ".join(word() for _ in range(20_000)), "en", "src4"), (507, " ".join(word() for _ in range(60)), "en", "src4"), out[4], out[4]]
    return out


def frame(spark, rows, schema="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame(rows, schema)


def clashing(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, True, "x", 4) for r in rows], CLASHING)


# --- lines ----------------------------------------------------------------------------------------------------------

def lines_by_hand(rows, min_sites):
    places, sites = defaultdict(list), defaultdict(set)
    for i, text, _, source in rows:
        for pos, line in enumerate((text or "").split("\n")) if text is not None else ():
            if key := line.strip(" \t\r"):
                places[key].append((-1 if i is None else i, text, pos))
                sites[key].add(source)
    # rows with equal ids are told apart by their text; which of them is first does not matter here
    wide = {k: min((i, p) for i, _, p in places[k]) for k in places if len(sites[k] - {None}) >= min_sites}
    out = []
    for i, text, _, _ in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        keep = [(p, x) for p, x in enumerate(text.split("\n"))
                if x.strip(" \t\r") not in wide or wide[x.strip(" \t\r")] == (-1 if i is None else i, p)]
        n = len(text.split("\n"))
        out.append((i, "\n".join(x for _, x in keep), n, n - len(keep)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_sites", [2, 10])
def test_line_dedup(spark, min_sites):
    rows = made()
    got = line_dedup.line_dedup(clashing(spark, rows), min_sites=min_sites)
    assert got.columns[:10] == clashing(spark, rows).columns
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "__n_lines", "__n_removed").collect()), key=repr) == lines_by_hand(rows, min_sites)


def test_lines_near_the_threshold_are_counted_exactly(spark):
    """With 64 registers estimates are off by 13 %, yet the outcome is exact."""
    rows = [(100 * k + s, f"line {k}", "en", f"s{s}") for k in range(40) for s in range(90 + k // 2)]
    lines = line_dedup._lines(frame(spark, rows), "doc_id", "text", "source")
    _, wide, _ = line_dedup.boilerplate(lines, min_sites=100, margin=0.6, lg_k=6)
    assert wide.count() == sum(90 + k // 2 >= 100 for k in range(40))


# --- quality --------------------------------------------------------------------------------------------------------

def counts_by_hand(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    seen, cover = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover),
            len(words) < 50 or 100 * len(cover) > 50 * len(words))


def test_quality_counts(spark):
    rows = made(2) + [(900 + i, t, "en", "s") for i, t in enumerate(["a a a a", "a b c a b c", "a b a b a b a", "# * <a> |b|\n\n#\n#", "😀 é #"])]
    got = quality.quality_rules(clashing(spark, rows))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((tuple(r) for r in got.select("doc_id", *names).collect()), key=repr) == sorted(
        ((r[0], *counts_by_hand(r[1])) for r in rows), key=repr)
    assert got.where("kept AND base_failed").count() == 0


def test_quality_learns_which_rules_matter(spark):
    """Two rules see the same fault; a third votes at random. Texts with the fault go, the others stay."""
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
        if i % 10 == 0:
            words = [w + rnd.choice(["%%%", "$$$", "&&&"]) for w in words]
        rows.append((i, " ".join(w + ("." if k % 12 == 11 else "") for k, w in enumerate(words)), "en", "s"))
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(frame(spark, rows)).collect()}
    assert all(got[i] == (i % 10 != 0) for i in got)


def test_quality_fit_alone():
    start = quality.fit([], ["a"])
    assert start == (quality.PRIOR, {"a": quality.ON_GOOD}, {"a": quality.ON_BAD})
    prior, good, bad = quality.fit([((1, 1), 900), ((-1, -1), 100)], ["a", "b"])
    assert abs(prior - 0.9) < 0.02 and good["a"] > 0.95 and bad["b"] > 0.8


# --- SimHash --------------------------------------------------------------------------------------------------------

def components_by_hand(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint_by_hand(text):
    import xxhash
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_documents(spark):
    rows = made(4)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_dedup(clashing(spark, rows)).collect()), key=repr)
    prints = [fingerprint_by_hand(r[1]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = components_by_hand(pairs, range(len(rows)))
    least = defaultdict(list)
    for i, r in root.items():
        least[r] += [rows[i][0]] if rows[i][0] is not None else []
    want = [(rows[i][0], f"{prints[i]:016x}", min(least[root[i]], default=None)) for i in range(len(rows))]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("dense, groups", [(0, None), (3, None), (256, None), (256, 1), (256, 2), (40, 2), (3, 2), (10_000, 1)])
def test_links_of_close_fingerprints(spark, dense, groups):
    """Whatever counts as dense, no link is lost: random fingerprints, chains of small steps and a crowded region."""
    rnd = random.Random(5)
    prints = {rnd.getrandbits(64) for _ in range(150)}
    chain = rnd.getrandbits(64)
    for _ in range(60):
        chain ^= 1 << rnd.randrange(64)
        chain ^= 1 << rnd.randrange(64)
        prints.add(chain)
    centre = rnd.getrandbits(64)
    prints |= {centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(200)} | {0, 1, 2**64 - 1}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    got = simhash.near_pairs(spark.createDataFrame([(s,) for s in signed], "fp long"), groups=groups, dense=dense).collect()
    close = {(a, b) for i, a in enumerate(signed) for j, b in enumerate(signed) if a < b and (prints[i] ^ prints[j]).bit_count() <= 2}
    links = {(r["a"], r["b"]) for r in got}
    assert links <= close
    assert components_by_hand(links, signed) == components_by_hand(close, signed)


def histogram_of(fp, groups):
    cells = simhash.cell_count(len(fp))
    counts = [np.bincount(simhash.cell(simhash.values(fp, g), len(g), cells), minlength=cells) for g in groups]
    return simhash.Histogram(groups, np.array(counts, np.int32), len(fp))


@pytest.mark.parametrize("total", [1_000_000, 10_000_000])
def test_the_method_holds_at_any_number_of_fingerprints(total):
    """Even fingerprints are not dense, clusters are; expected candidates are what the index would bring."""
    rnd = np.random.default_rng(21)
    fp = rnd.integers(-2**63, 2**63, total)
    fp[:5000] = fp[0] ^ (1 << rnd.integers(0, 8, 5000)) ^ (1 << rnd.integers(0, 8, 5000)) ^ rnd.integers(0, 1 << 12, 5000)
    bits = np.array_split(np.arange(64), simhash.group_count(total))
    h = histogram_of(fp, [b.tolist() for b in bits])
    sample = fp[np.concatenate([np.arange(500), np.arange(6000, 26_000)])]
    cost, thresholds = simhash.costs(sample, h, 2)
    assert (thresholds.sum(axis=1) == 2 - len(bits) + 1).all()
    assert (cost[500:] > simhash.DENSE).mean() < 0.05 and (cost[:500] > simhash.DENSE).all()
    v = simhash.values(fp, h.groups[0])
    others = np.bincount(v.astype(np.int64), minlength=1 << len(h.groups[0]))[simhash.values(sample[500:], h.groups[0]).astype(np.int64)] - 1
    assert 0.5 * others.mean() <= h.expected(0, simhash.values(sample[500:], h.groups[0])).mean() <= 2 * others.mean()


def test_groups_follow_the_number_of_fingerprints():
    counts = [simhash.group_count(n) for n in (10, 10**6, 10**7, 10**8, 10**9, 10**10)]
    assert counts == sorted(counts, reverse=True) and counts[0] == 3 and counts[-1] == 2
    assert all(simhash.even_cost(n, simhash.group_count(n), 2) <= simhash.DENSE for n in (10**6, 10**7, 10**8, 10**9, 10**10))
    assert simhash.cell_count(10**12) == simhash.CELLS
    x = simhash.cell(np.arange(1 << 21, dtype=np.uint64), 21, 1 << 16)
    assert np.bincount(x, minlength=1 << 16).min() > 0


def test_links_among_many_fingerprints(spark):
    """Every planted neighbour is found among 60,000 even fingerprints, in both widths of groups."""
    rnd = np.random.default_rng(23)
    fp = np.unique(rnd.integers(-2**63, 2**63, 60_000))
    near = fp[:300] ^ (1 << rnd.integers(0, 64, 300)) ^ (1 << rnd.integers(0, 64, 300))
    want = {(min(a, b), max(a, b)) for a, b in zip(fp[:300].tolist(), near.tolist()) if a != b}
    df = spark.createDataFrame([(x,) for x in set(fp.tolist()) | set(near.tolist())], "fp long")
    for groups in (3, 2):
        got = {(r["a"], r["b"]) for r in simhash.near_pairs(df, groups=groups).collect()}
        assert want <= got and all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in got)


def test_allocation_is_the_cheapest_that_is_complete():
    rnd = np.random.default_rng(6)
    cost = rnd.integers(1, 100, (50, 3, 4)).astype(float)
    cost[:, :, 0] = 0
    best, thresholds = simhash.allocate(cost, 2)
    for k in range(50):
        options = {(a, b, c): cost[k, 0, a] + cost[k, 1, b] + cost[k, 2, c] for a in range(4) for b in range(4) for c in range(4) if a + b + c == 3}
        assert best[k] == min(options.values())
        assert options[tuple(thresholds[k] + 1)] == best[k]


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(7)
    pairs = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(rnd.randrange(3000, 3200), rnd.randrange(3000, 3200)) for _ in range(150)]
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == components_by_hand(pairs, {x for p in pairs for x in p})


# --- passages -------------------------------------------------------------------------------------------------------

def passages_by_hand(rows, window):
    first = {}
    words = [[] if t is None else WORDS.findall(t) for _, t, *_ in rows]
    for (i, *_), w in zip(rows, words):
        for s in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[s:s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, *_), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[s:s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window, run", [(50, 12), (8, 3), (5, 5)])
def test_substring_dedup(spark, window, run):
    rows = made(8)
    got = substring_dedup.substring_dedup(clashing(spark, rows), window=window, run=run)
    kept = F.when(F.col("left").isNull(), F.col("words_sha256")).otherwise(F.sha2(F.col("left"), 256))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", kept).collect()), key=repr) == passages_by_hand(rows, window)


@pytest.mark.parametrize("shared", [12, 40])
def test_substring_dedup_of_a_run_between_different_words(spark, monkeypatch, shared):
    """Buckets of a passage that many documents have between words of their own are cut until they are small."""
    rnd = random.Random(22)
    word = lambda: f"w{rnd.randrange(10**6)}"
    passage, flank = " ".join(word() for _ in range(shared)), " ".join(word() for _ in range(45))
    rows = [(i, " ".join([*(word() for _ in range(45)), passage, flank if i % 4 == 0 else " ".join(word() for _ in range(45))]), "en", "src1") for i in range(80)]
    rows += [(200, "same " * 300, "en", "src1"), (201, "same " * 200, "en", "src1")]
    seen, least = [], substring_dedup._least_documents
    monkeypatch.setattr(substring_dedup, "_least_documents", lambda strings, window: seen.append(strings) or least(strings, window))
    got = substring_dedup.substring_dedup(frame(spark, rows), crowded=200)
    kept = F.when(F.col("left").isNull(), F.col("words_sha256")).otherwise(F.sha2(F.col("left"), 256))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", kept).collect()), key=repr) == passages_by_hand(rows, 50)
    windows = defaultdict(set)
    for r in seen[0].collect():
        words = bytes(r["packed"]).split()
        windows[r["minimiser"]] |= {b" ".join(words[i:i + 50]) for i in range(len(words) - 49)}
    assert max(map(len, windows.values())) <= 200


def test_substring_dedup_cuts_crowded_buckets_without_a_shuffle(spark):
    """Rounds shuffle no strings, however many there are, and each is read once in what they leave."""
    rnd = random.Random(24)
    word = lambda: f"w{rnd.randrange(10**6)}".encode()
    passage, out = [word() for _ in range(24)], []
    for d in range(80):
        words = [*(word() for _ in range(40)), *passage, *(word() for _ in range(40))]
        for m, s, k in zip(*(x.tolist() for x in substring_dedup.super_kmers(words, 50, 12))):
            out.append((m, b" ".join(words[s:s + k + 49]), d, d, s, k, m))
    packed = spark.createDataFrame(out, substring_dedup._PACKED).withColumn("string_hash", F.unhex(F.md5("packed")))
    got = substring_dedup._spread(substring_dedup.staged(packed), 50, 12, 200)
    plan = got._jdf.queryExecution().executedPlan().toString()
    scans = plan.count("FileScan")
    assert "hashpartitioning" not in plan and scans > 1 and plan.count("BroadcastExchange") == scans // 2
    windows = lambda rows: sorted((r["doc"], r["start"] + i) for r in rows for i in range(r["size"]))
    assert windows(got.collect()) == windows(packed.collect())


def test_super_k_mers_hold_each_window_once():
    words = [f"w{i % 37 * i}".encode() for i in range(500)]
    _, start, size = substring_dedup.super_kmers(words, 50, 12)
    assert list(start) == list(np.cumsum(size) - size) and size.sum() == 451
    assert not len(substring_dedup.super_kmers(words[:49], 50, 12)[0])


# --- mixing ---------------------------------------------------------------------------------------------------------

def filled(budget, children):
    """{name: (capacity, weight)} to {name: share}: rounds of sharing by weight until nobody overflows."""
    out, left, open_ = {}, budget, dict(children)
    while True:
        weight = sum(w for _, w in open_.values())
        full = {k for k, (c, w) in open_.items() if c * weight <= left * w}
        if not full:
            return out | {k: left * w / weight for k, (c, w) in open_.items()}
        for k in full:
            out[k] = open_.pop(k)[0]
        left = budget - sum(v for k, v in out.items())


def test_mixing_budgets_and_prefixes(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "en", "de", None]), f"src{rnd.randint(0, 8)}") for i in range(400)]
    rows += [(1000, None, "en", "src1"), (None, "no id here", "en", "src1"), rows[3], rows[3]]
    weights = {"domain": {"a": 5, "b": 1}, "lang": {"en": 3}, "source": {"src4": 7}}
    domain = F.when(F.col("source") < "src3", "a").when(F.col("source") < "src7", "b")
    got = mixing.mix_sources(frame(spark, rows), domain, F.col("lang"), F.col("source"), mixing.n_words(F.col("text")), weights, percent=120, max_epochs=3).collect()
    assert len(got) == len(rows)
    tree = defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
    for r in got:
        tree[r["domain"]][r["lang"]][r["source"]] += r["n_tokens"]
    total = sum(r["n_tokens"] for r in got)
    cap = lambda t: sum(map(cap, t.values())) if isinstance(t, dict) else 3 * t
    w = lambda level, k: weights[level].get(k, 1)
    budget = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in got}
    for d, share in filled(total * 120 // 100, {k: (cap(t), w("domain", k)) for k, t in tree.items()}).items():
        for l, part in filled(share, {k: (cap(t), w("lang", k)) for k, t in tree[d].items()}).items():
            for s, own in filled(part, {k: (cap(t), w("source", k)) for k, t in tree[d][l].items()}).items():
                assert abs(budget[d, l, s] - own) <= 3
    assert sum(budget.values()) == total * 120 // 100
    leaves = defaultdict(list)
    for r in got:
        leaves[r["domain"], r["lang"], r["source"]].append(r)
    for key, mine in leaves.items():
        size = sum(r["n_tokens"] for r in mine)
        epochs = budget[key] // size if size else 0
        order = sorted(mine, key=lambda r: (hashlib.md5(f"42:{epochs}:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest(), r["text_hash"]))
        used, want = 0, []
        for r in order:
            used += r["n_tokens"]
            want.append(epochs + (size > 0 and budget[key] % size > 0 and used <= budget[key] % size))
        assert sorted((str(r["doc_id"]), c) for r, c in zip(order, want)) == sorted((str(r["doc_id"]), r["copies"]) for r in order)


def test_mixed_rows_come_as_often_as_chosen(spark):
    rows = made(10)
    docs = clashing(spark, rows)
    chosen = mixing.mix_sources(docs, F.lit("one"), F.col("lang"), F.col("source"), mixing.n_words(F.col("text")), {}, percent=150, max_epochs=2)
    got = mixing.mixed(docs.dropDuplicates(["doc_id", "text"]), chosen)
    assert got.columns == docs.columns
    want = Counter()
    for r in chosen.collect():
        want[r["doc_id"], r["text_hash"]] += r["copies"]
    assert Counter((r["doc_id"], r["h"]) for r in got.select("doc_id", F.xxhash64("text").alias("h")).collect()) == +want


def test_mixed_repeated_rows_stay_within_the_budget(spark):
    """The rows that mix_sources saw, with k equal ones, and one id and text in two sources."""
    rows = made(10)
    rows += [rows[7]] * 3 + [(*rows[8][:3], "src77"), (None, "no id", "en", "src3")]
    docs = clashing(spark, rows)
    leaf = {"domain": F.lit("one"), "lang": F.col("lang"), "source": F.col("source")}
    chosen = mixing.mix_sources(docs, **leaf, tokens=mixing.n_words(F.col("text")), weights={}, percent=150, max_epochs=2)
    got = mixing.mixed(docs, chosen, leaf=leaf)
    assert got.columns == docs.columns
    want = Counter()
    for r in chosen.collect():
        want[r["doc_id"], r["text_hash"], r["lang"], r["source"]] += r["copies"]
    seen = got.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"))
    assert Counter(map(tuple, seen.collect())) == +want
    plain = mixing.mixed(docs, chosen)  # without the levels: as often in all
    assert plain.count() == sum(want.values())


# --- exact ----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("history", ["doc_id < 90", "false", "true", "doc_id IS NULL"])
def test_exact_dedup(spark, history):
    rows = made(11)
    got = exact_dedup.exact_dedup(clashing(spark, rows), F.expr(history)).collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[low(t)].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, best[low(t)], len(groups[low(t)]), i == best[low(t)], hashlib.sha256(low(t).encode()).hexdigest()) for i, t, *_ in rows]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)


def test_perfect_hash_fills_every_slot_once():
    rnd = np.random.default_rng(12)
    for n in (1, 2, 7, 500, 4000):
        digest = rnd.integers(0, 2**63, (n, 4)).astype(np.uint64)
        displacement, slot = exact_dedup.build_mph(digest)
        assert sorted(slot) == list(range(n))
        group, a, b = exact_dedup._places(digest, len(displacement))
        assert (exact_dedup._slots(a, b, displacement[group], n) == slot).all()


# --- empty tables ---------------------------------------------------------------------------------------------------

def test_empty_tables(spark):
    none = frame(spark, [])
    assert line_dedup.line_dedup(none).count() == 0
    assert quality.quality_rules(none).count() == 0
    assert simhash.simhash_dedup(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert mixing.mix_sources(none, F.lit("a"), F.col("lang"), F.col("source"), mixing.n_words(F.col("text")), {}).count() == 0
    assert exact_dedup.exact_dedup(none, F.lit(True)).count() == 0
