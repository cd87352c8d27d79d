"""Substring dedup: word windows that repeat across documents, found by super-k-mer partitioning.

A window's minimiser is the least hash of its m-word runs, so equal windows have equal minimisers. Consecutive windows
that share a minimiser travel as one packed string, a super-k-mer, to the minimiser's bucket, where the windows are
sorted and the least document of each is found. Only super-k-mers whose minimiser occurs in two documents or more need to
travel; which those are is found first from the hashes alone. Equal packed strings are merged before the shuffle.

A run that many documents share between different words brings one different string per document to one bucket. Buckets of
too many windows are cut again by the next least hash of each window's runs, and again, until none is crowded. The order of a
window's hashes depends on the window alone, so equal windows stay together.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.shared import lookup, row_key, staged
from schemaloom.shipping import ship

#: Words in a window and in the runs that minimisers are taken from.
WINDOW, RUN = 50, 12
#: Windows of different strings from which on a bucket is cut again.
CROWDED = 1 << 14
#: In place of a hash: the windows have no further run.
_NONE = np.uint64(2**64 - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes.split: the six ASCII blanks only


def run_hashes(words: list[bytes], run: int) -> np.ndarray:
    """A hash per run of `run` words."""
    one = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    runs = len(words) - run + 1
    mixed = np.zeros(runs, np.uint64)
    for j in range(run):
        mixed = mixed * _BASE + one[j:j + runs]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return mixed


def super_kmers(words: list[bytes], window: int, run: int, above: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of each super-k-mer of one document.

    With `above` the minimiser is the least hash above that one, and all bits set if a window has none.
    """
    n = len(words)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    least = run_hashes(words, run)
    if above is not None:
        least = np.where(least > np.int64(above).astype(np.uint64), least, _NONE)
    span = window - run + 1  # runs in a window
    width = 1
    while width < span:  # minima of doubling widths
        step = min(width, span - width)
        least = np.minimum(least[:len(least) - step], least[step:])
        width += step
    cut = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return least[cut].astype(np.int64), cut.astype(np.int32), np.diff(np.append(cut, len(least))).astype(np.int32)


def _scan(docs: DataFrame, window: int, run: int) -> DataFrame:
    """Per row: words, hash of all words, and its super-k-mers as three arrays."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"n_words": [], "sha": [], "minimiser": [], "start": [], "size": []}
            for text in b.column(2):
                words = words_of(text.as_py())
                m, s, k = super_kmers(words, window, run)
                out["n_words"].append(len(words))
                out["sha"].append(hashlib.sha256(b" ".join(words)).hexdigest())
                for name, x in (("minimiser", m), ("start", s), ("size", k)):
                    out[name].append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out["n_words"], pa.int64()), pa.array(out["sha"], pa.string()),
                 *(pa.array(out[k], pa.list_(t)) for k, t in (("minimiser", pa.int64()), ("start", pa.int32()), ("size", pa.int32())))],
                ["doc", "text_hash", *out])

    return docs.mapInArrow(scanned, "doc long, text_hash long, n_words long, sha string, minimiser array<long>, "
                                    "start array<int>, size array<int>")


def _packed(suspects: DataFrame, window: int) -> DataFrame:
    """The super-k-mers to compare, each as the words of all its windows in one string."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, text_hash, texts, parts = (b.column(i) for i in range(4))
            out: list[tuple] = []
            held = 0
            for d, h, text, kmers in zip(doc, text_hash, texts, parts):
                words, d, h = words_of(text.as_py()), d.as_py(), h.as_py()
                for k in kmers.as_py():
                    s, n = k["start"], k["size"]
                    out.append((k["minimiser"], b" ".join(words[s:s + n + window - 1]), d, h, s, n, k["minimiser"]))
                    held += len(out[-1][1])
                if held > 4 << 20:
                    yield _rows(out)
                    out, held = [], 0
            yield _rows(out)

    return suspects.select("doc", "text_hash", "text", "kmers").mapInArrow(
        packed, _PACKED).withColumn("string_hash", F.unhex(F.md5("packed")))


#: `last` is the hash that the windows were cut by last, and `minimiser` the bucket: at first the same, then mixed from all of them.
_PACKED = "minimiser long, packed binary, doc long, text_hash long, start int, size int, last long"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out)) or [[]] * 7
    types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                      ["minimiser", "packed", "doc", "text_hash", "start", "size", "last"])


def _cut_again(packed: DataFrame, window: int, run: int) -> DataFrame:
    """The strings of `packed` cut by the least hash above their last one, as `_packed` has them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            held = 0
            for bucket, string, d, h, start, last in zip(*(c.to_pylist() for c in b.columns)):
                words = string.split(b" ")
                for m, s, n in zip(*(x.tolist() for x in super_kmers(words, window, run, last))):
                    out.append((xxhash.xxh64_intdigest(struct.pack("<qq", bucket, m)) - 2**63, b" ".join(words[s:s + n + window - 1]), d, h, start + s, n, m))
                    held += len(out[-1][1])
                if held > 4 << 20:
                    yield _rows(out)
                    out, held = [], 0
            yield _rows(out)

    return packed.select("minimiser", "packed", "doc", "text_hash", "start", "last").mapInArrow(
        cut, _PACKED).withColumn("string_hash", F.unhex(F.md5("packed")))


def _spread(packed: DataFrame, window: int, run: int, crowded: int) -> DataFrame:
    """`packed` (staged) with buckets of over `crowded` windows in different strings cut again until there are none.

    Each round uses up one run of the window, so there are fewer rounds than runs in a window. Windows left together
    then have the same set of runs, that is, the same words but for the order of repeats. There is at most one full bucket
    to `crowded` windows, so they are broadcast: a round shuffles no strings, and what it leaves is read as it was written.
    """
    out = None
    while True:
        strings = (packed.where(F.col("last") != int(_NONE.astype(np.int64))).groupBy("minimiser", "string_hash")
                   .agg(F.first("size").alias("size")))
        full = staged(strings.groupBy("minimiser").agg(F.sum("size").alias("windows"))
                      .where(F.col("windows") > crowded).select("minimiser"))
        if full.isEmpty():
            return packed if out is None else out.unionByName(packed)
        rest = packed.join(F.broadcast(full), "minimiser", "left_anti")
        out = rest if out is None else out.unionByName(rest)
        packed = staged(_cut_again(packed.join(F.broadcast(full), "minimiser", "left_semi"), window, run))


def _least_documents(strings: DataFrame, window: int) -> DataFrame:
    """`strings` (minimiser, packed, doc: the least with it, n: rows) with the least document of each window, as offsets.

    Rows come bucket by bucket and in order of document, so the first to bring a window has its least document. Only
    windows of the bucket at hand are held, as 16-byte digests.
    """

    def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, first = None, {}
        for b in batches:
            out = []
            for m, packed, doc in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if m != bucket:
                    bucket, first = m, {}
                words = packed.split(b" ")
                ends = np.cumsum([len(w) + 1 for w in words])
                least = []
                for i in range(len(words) - window + 1):
                    here = packed[ends[i - 1] if i else 0:ends[i + window - 1] - 1]
                    least.append(first.setdefault(xxhash.xxh3_128_digest(here), doc))
                out.append(least)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), pa.array(out, pa.list_(pa.int64()))],
                                             ["minimiser", "string_hash", "n", "least"])

    return (strings.repartition("minimiser").sortWithinPartitions("minimiser", "doc")
            .select("minimiser", "packed", "doc", "string_hash", "n")
            .mapInArrow(sorted_out, "minimiser long, string_hash binary, n long, least array<long>"))


def _without(suspects: DataFrame, window: int) -> DataFrame:
    """Suspects (text, spans: starts of windows to remove) with what is left of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, kept = [], []
            for text, starts in zip(b.column(2), b.column(3)):
                words = words_of(text.as_py())
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.asarray(starts.as_py(), np.int64))
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone) if not g))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()),
                                              pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string())],
                                             ["doc", "text_hash", "n_removed", "left"])

    return suspects.select("doc", "text_hash", "text", "starts").mapInArrow(
        cut, "doc long, text_hash long, n_removed long, left string")


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, run: int = RUN,
                    crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_words, n_removed, left (the remaining words; null if nothing was removed), words_sha256 (of all words).

    A word goes if it is covered by a window of `window` consecutive words that also starts in a document with a smaller
    id. Null texts have no words. Rows without an id neither lose words nor count as a source of others. Rows with the
    same id do not count as smaller to each other.
    """
    ship(docs.sparkSession)
    doc, text_hash = row_key(doc_id, text)
    rows = docs.where(F.col(doc_id).isNotNull()).select(doc.alias("doc"), text_hash.alias("text_hash"), F.col(text).alias("text"))
    lost = docs.where(F.col(doc_id).isNull()).select(F.lit(None).cast("long").alias("doc"), text_hash.alias("text_hash"), F.col(text).alias("text"))
    scan = staged(_scan(rows.unionByName(lost), window, run))
    kmers = (scan.where("doc IS NOT NULL")
             .select("doc", "text_hash", F.explode(F.arrays_zip("minimiser", "start", "size")).alias("k")).select("doc", "text_hash", "k.*"))
    shared = staged(kmers.groupBy("minimiser").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n"))
                    .where("a < b").select("minimiser", "n"))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = (lookup(kmers, shared, ["minimiser"], "n", total, "inner")
              .groupBy("doc", "text_hash").agg(F.collect_set(F.struct("minimiser", "start", "size")).alias("kmers")))
    suspects = staged(rows.dropDuplicates(["doc", "text_hash"]).join(wanted, ["doc", "text_hash"]))
    packed = _spread(staged(_packed(suspects, window)), window, run, crowded)
    strings = packed.groupBy("minimiser", "packed", "string_hash").agg(F.min("doc").alias("doc"), F.count("*").alias("n"))
    least = staged(_least_documents(strings, window))
    places = packed.select("minimiser", "string_hash", "doc", "text_hash", "start")
    n_places = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # each string is in `least` with the number of its places
    again = (lookup(places, least, ["minimiser", "string_hash"], "n", n_places, "inner")
             .select("doc", "text_hash", "start", F.posexplode("least").alias("i", "first")).where("first < doc")
             .groupBy("doc", "text_hash").agg(F.collect_set(F.col("start") + F.col("i")).alias("starts")))
    left = _without(suspects.drop("kmers").join(again, ["doc", "text_hash"]), window)
    return (scan.drop("minimiser", "start", "size").join(left, ["doc", "text_hash"], "left")
            .select(F.col("doc").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                    "left", F.col("sha").alias("words_sha256")))
