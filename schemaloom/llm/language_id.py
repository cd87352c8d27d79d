"""Language ID with one interpolated Kneser-Ney character model per language.

Models are over words: runs of letters, lower-cased, with boundary marks. All models share one sorted array of n-gram
hashes per order, with a row of log probabilities (of interpolation weights, for contexts) that has a column per
language. The language with the lowest cross-entropy per character wins. Rejection and score are calibrated on labelled
rows kept out of the counts: how far a text's cross-entropy may lie above its language's mean is measured on pieces of those
texts, from a few words to whole texts, and set so that a stated share of them is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.shared import kept as kept_in_worker
from schemaloom.llm.shared import staged
from schemaloom.shipping import ship

ORDER = 4
#: Labelled rows that the models are fitted on, per language and on average; they are chosen by a hash of the id.
SAMPLE = 400
#: Share of the calibration pieces of a language that its limit rejects, and their sizes in letters besides whole texts.
FALSE_REJECT, PIECES = 0.001, (20, 40, 80, 160, 400)
#: Deviations that no limit goes below: a sample of pieces says little about its own tail.
LEAST_LIMIT = 4.0
#: Share of a text that may be in another language, such as quotations, names or code, before it counts against the text.
FOREIGN = 0.3
#: Words that a task remembers the scores of.
REMEMBERED = 200_000
EDGE = "\x02"
_RUNS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x100000001B3)


@dataclass
class Model:
    """order k (1..ORDER): sorted hashes of k-grams, log probabilities; contexts of k characters and their log weights."""
    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    unseen: np.ndarray  # log probability of a character that no model knows
    mean: np.ndarray
    between: np.ndarray  # variance of texts' means beyond what their length explains
    within: np.ndarray  # variance that a character adds to the sum of a text's log probabilities
    slack: np.ndarray  # what a text's mean rises by if `FOREIGN` of it is in another language
    limit: np.ndarray  # deviations beyond which a text is rejected
    sharpness: float


def words_of(run: str) -> list[str]:
    """Runs of letters in a lower-cased run, as the counts have them: marks and numerals part words."""
    low = run.lower()
    return [low] if low.isalpha() else "".join(c if c.isalpha() else " " for c in low).split()


def gram_hash(codes: np.ndarray) -> np.ndarray:
    """Hashes of the rows of character codes."""
    h = np.full(len(codes), 0xCBF29CE484222325, np.uint64)
    for j in range(codes.shape[1]):
        h = (h ^ codes[:, j].astype(np.uint64)) * _BASE
        h ^= h >> np.uint64(29)
    return h


def _codes(grams: list[str]) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(grams), -1)


def count_grams(words: DataFrame, order: int = ORDER) -> DataFrame:
    """(k, lang, gram, n) from `words` (lang, word, n): counts at the highest order, below it the number of different
    characters that come before the gram."""
    padded = F.concat(F.lit(EDGE * (order - 1)), F.col("word"), F.lit(EDGE))
    top = (words.select("lang", "n", padded.alias("p"))
           .select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - (order - 1)), lambda i: F.substr("p", i, F.lit(order)))).alias("gram"))
           .groupBy("lang", "gram").agg(F.sum("n").alias("n")).select(F.lit(order).alias("k"), "lang", "gram", "n"))
    out = here = staged(top)
    for k in range(order - 1, 0, -1):
        here = here.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "lang", "gram", "n")
        out = out.unionByName(here)
    return out


def fit(counts: list[tuple[int, str, str, int]], langs: list[str], order: int = ORDER) -> Model:
    """Interpolated probabilities of all n-grams that any language has."""
    tables = [{} for _ in range(order + 1)]
    for k, lang, gram, n in counts:
        tables[k].setdefault(gram, np.zeros(len(langs)))[langs.index(lang)] += n
    alphabet = max(2, len(tables[1]) + 1)
    grams, contexts = [], []
    lower_p: dict[str, np.ndarray] = {}
    unseen = np.full(len(langs), 1.0 / alphabet)
    for k in range(1, order + 1):
        names = sorted(tables[k])
        if not names:
            grams.append((np.empty(0, np.uint64), np.empty((0, len(langs)))))
            contexts.append((np.empty(0, np.uint64), np.empty((0, len(langs)))))
            continue
        n = np.array([tables[k][g] for g in names])
        ones, twos = (n == 1).sum(axis=0), (n == 2).sum(axis=0)
        discount = np.clip(np.where(ones + twos > 0, ones / np.maximum(1, ones + 2 * twos), 0.5), 0.1, 0.9)
        heads, at = np.unique([g[:-1] for g in names], return_inverse=True)
        total, kinds = np.zeros((len(heads), len(langs))), np.zeros((len(heads), len(langs)))
        np.add.at(total, at, n)
        np.add.at(kinds, at, n > 0)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        # a gram's tail is always known one order lower, as lower orders count the same places
        below = np.array([lower_p[g[1:]] for g in names]) if k > 1 else np.full(n.shape, 1.0 / alphabet)
        p = np.where(total[at] > 0, np.maximum(n - discount, 0) / np.maximum(total[at], 1), 0) + weight[at] * below
        if k == 1:
            unseen = weight[0] / alphabet
        lower_p = dict(zip(names, p))
        for keys, what, to in ((names, p, grams), (heads.tolist(), weight, contexts)):
            h = gram_hash(_codes(keys)) if keys != [""] else np.array([0], np.uint64)
            by = np.argsort(h)
            to.append((h[by], np.log(what[by])))
    size = len(langs)
    return Model(langs, grams, contexts, np.log(unseen), np.zeros(size), np.ones(size), np.ones(size), np.zeros(size), np.full(size, LEAST_LIMIT), 1.0)


def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, _ = table
    if not len(keys):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h, at


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """[word, 0]: characters (with the end mark); [word, 1 + l]: log probability in language l. Words without letters: 0."""
    order, out = len(model.grams), np.zeros((len(words), 1 + len(model.langs)))
    real = [i for i, w in enumerate(words) if w]
    if not real:
        return out
    pads = [EDGE * (order - 1) + words[i] + EDGE for i in real]
    codes = np.frombuffer("".join(pads).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(p) for p in pads])
    ends = np.concatenate([np.arange(s + order - 1, s + n) for s, n in zip(np.cumsum(sizes) - sizes, sizes)])
    windows = codes[ends[:, None] + np.arange(1 - order, 1)]
    logp, todo = np.zeros((len(ends), len(model.langs))), np.arange(len(ends))
    for k in range(order, 0, -1):
        if not len(todo):
            break
        hit, at = _find(model.grams[k - 1], gram_hash(windows[todo][:, order - k:]))
        logp[todo[hit]] += model.grams[k - 1][1][at[hit]]
        todo = todo[~hit]
        if k > 1 and len(todo):  # weight of the context that did not know the character
            known, at = _find(model.contexts[k - 1], gram_hash(windows[todo][:, order - k:-1]))
            logp[todo[known]] += model.contexts[k - 1][1][at[known]]
    logp[todo] += model.unseen
    out[real, 0] = sizes - (order - 1)
    out[np.ix_(real, range(1, 1 + len(model.langs)))] = np.add.reduceat(logp, np.cumsum(sizes - order + 1) - (sizes - order + 1))
    return out


class Scorer:
    """Scores texts, remembering words. At the limit it starts anew, so memory is bounded."""

    def __init__(self, model: Model):
        self.model, self.ids, self.rows = model, {}, np.zeros((1024, 1 + len(model.langs)))

    def _learn(self, texts: list[str | None]) -> list[list[str]]:
        """The texts' runs, all of which are known afterwards."""
        if len(self.ids) > REMEMBERED:
            self.ids, self.rows = {}, self.rows[:1024]
        runs = [_RUNS.findall(t) if t else [] for t in texts]
        new = list({w for r in runs for w in r if w not in self.ids})
        if new:
            base = len(self.ids)
            while base + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.ids.update(zip(new, range(base, base + len(new))))
            self.rows[base:base + len(new)] = 0
            for at in range(0, len(new), 4096):
                words = [(base + k, w) for k, run in enumerate(new[at:at + 4096], at) for w in words_of(run)]
                np.add.at(self.rows, [k for k, _ in words], word_scores(self.model, [w for _, w in words]))
        return runs

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Per text: number of characters scored, log probability per language."""
        runs = self._learn(texts)
        return np.array([self.rows[[self.ids[w] for w in r]].sum(axis=0) if r else np.zeros(self.rows.shape[1]) for r in runs])

    def runs(self, text: str) -> np.ndarray:
        """The same per run of the text."""
        found = self._learn([text])[0]  # may replace the rows
        return self.rows[[self.ids[w] for w in found]].reshape(-1, self.rows.shape[1])


def deviations(model: Model, lang: np.ndarray, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How far texts of `n` characters lie above their languages' means, in what is usual for that length."""
    return (entropy - model.mean[lang] - model.slack[lang]) / np.sqrt(model.between[lang] + model.within[lang] / np.maximum(n, 1))


def judge(model: Model, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language's number or -1, score, deviations from the language's mean) per row of `Scorer.texts`."""
    n = sums[:, :1]
    entropy = np.where(n > 0, -sums[:, 1:] / np.maximum(n, 1), 0)
    if not model.langs:
        return np.full(len(sums), -1), np.zeros(len(sums)), np.zeros(len(sums))
    best = entropy.argmin(axis=1)
    rows = np.arange(len(sums))
    odds = np.exp(-model.sharpness * (entropy - entropy[rows, best][:, None]))
    z = deviations(model, best, entropy[rows, best], n[:, 0])
    there = n[:, 0] > 0
    return np.where(there, best, -1), np.where(there, 1 / odds.sum(axis=1), 0.0), np.where(there, z, 0.0)


def pieces(runs: np.ndarray, sizes: tuple[int, ...] = PIECES) -> np.ndarray:
    """Sums of consecutive rows of `Scorer.runs`: for each size pieces of at least so many characters, and all rows together."""
    upto = np.concatenate([np.zeros((1, runs.shape[1])), np.cumsum(runs, axis=0)])
    out = [upto[-1:]]
    for size in sizes:
        cuts = np.unique(np.searchsorted(upto[:, 0], np.arange(0, upto[-1, 0] + 1, size)))
        out.append(np.diff(upto[cuts], axis=0))
    out = np.concatenate(out)
    return out[out[:, 0] > 0]


def calibrate(model: Model, held: list[tuple[str, str]]) -> None:
    """Means, variances and limits per language, and the sharpness under which scores fit held-out languages best.

    A language without texts to calibrate on takes what all together give.
    """
    scorer = Scorer(model)
    runs = [(model.langs.index(x), r) for x, t in held if (r := scorer.runs(t))[:, 0].sum() > 0]
    if not runs:
        model.mean[:], model.between[:] = 0, 1e6  # nothing to calibrate on: nothing is rejected
        return
    lang, sums = np.array([l for l, _ in runs]), np.array([r.sum(axis=0) for _, r in runs])
    entropy = -sums[:, 1:] / sums[:, :1]
    for l in range(len(model.langs)):
        mine = [(r, k) for k, r in runs if k == l] or [(r, k) for k, r in runs]
        n = np.array([r[:, 0].sum() for r, _ in mine])
        own = np.array([-r[:, 1 + k].sum() for r, k in mine]) / n
        # what the words of a text add to the variance of its sum, a character
        spread = [((r[:, 1 + k] + r[:, 0] * h) ** 2).sum() for (r, k), h in zip(mine, own)]
        model.mean[l], model.within[l] = np.median(own), max(1e-3, sum(spread) / n.sum())
        model.between[l] = max(1e-4, np.median(np.abs(own - model.mean[l])) ** 2 * 1.4826 ** 2 - model.within[l] / np.median(n))
        others = entropy[lang != l, l]
        strange = np.median(others) if len(others) else -model.unseen[l]  # a lone language is told from unknown characters
        model.slack[l] = FOREIGN * max(0.0, strange - model.mean[l])
        cut = [(pieces(r), k) for r, k in mine]
        z = np.concatenate([deviations(model, np.full(len(p), l), -p[:, 1 + k] / p[:, 0], p[:, 0]) for p, k in cut])
        model.limit[l] = max(LEAST_LIMIT, float(np.quantile(z, 1 - FALSE_REJECT, method="higher")))
    fits = []
    for sharp in (1.0, 2.0, 5.0, 10.0, 20.0, 50.0):
        logit = -sharp * entropy
        logit -= logit.max(axis=1, keepdims=True)
        fits.append((float((logit[np.arange(len(lang)), lang] - np.log(np.exp(logit).sum(axis=1))).mean()), -sharp))
    model.sharpness = -max(fits)[1]


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from about `sample` whole texts per language (all, if there are fewer); a fifth of them calibrates."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.lit(7), doc_id), F.lit(1_000_000)).alias("draw"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    langs = sorted(sizes)
    if not langs:
        return Model([], [], [], *[np.empty(0)] * 6, 1.0)
    share = F.lit(0)
    for l in langs:
        share = F.when(F.col("lang") == l, int(min(1.0, sample / sizes[l]) * 1_000_000)).otherwise(share)
    drawn = staged(rows.where(F.col("draw") <= share).withColumn("held", F.col("draw") % 5 == 0))
    runs = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))
    words = drawn.where(~F.col("held")).select("lang", F.explode(runs).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    model = fit([tuple(r) for r in count_grams(words).collect()], langs)  # as many n-grams as the sample has
    calibrate(model, [(r["lang"], r["text"]) for r in drawn.where("held").select("lang", "text").collect()])
    return model


def _rejected(model: Model, best: np.ndarray, z: np.ndarray) -> np.ndarray:
    return (best < 0) | (z > np.append(model.limit, 0.0)[best])  # -1 takes the last


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, lang_pred, score, deviation, rejected for every row of `docs`.

    lang_pred is "und" and the row rejected if the text is null or has no letter, or there is no model. A text is also
    rejected if its cross-entropy lies more deviations above what is usual for texts of its length than its language's limit.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept_in_worker(shared, Scorer)
        model = scorer.model
        names = np.array([*model.langs, "und"], dtype=object)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                best, score, z = judge(model, scorer.texts(b.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(names[best], pa.string()), pa.array(score), pa.array(z), pa.array(_rejected(model, best, z))],
                    ["doc_id", "text_hash", "lang_pred", "score", "deviation", "rejected"])

    return rows.mapInArrow(scored, f"doc_id {kind}, text_hash long, lang_pred string, score double, deviation double, rejected boolean")


def kept(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs` that are not rejected, as they are."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept_in_worker(shared, Scorer)
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                b = whole.slice(start, 64)
                best, _, z = judge(scorer.model, scorer.texts(b.column(at).to_pylist()))
                yield b.filter(pa.array(~_rejected(scorer.model, best, z)))

    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # whatever characters the names have
    return plain.mapInArrow(accepted, plain.schema).toDF(*docs.columns)


def in_fold(doc_id: Column, folds: int = 5) -> Column:
    """Is the row held out: crc32 of the id as text divisible by `folds`. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
