"""SimHash near-dedup by the generalised pigeonhole principle.

The 64 bits are cut into groups of correlated bits. If thresholds of the groups add up to d - groups + 1, two
fingerprints at distance d or less agree within its threshold in at least one group (threshold -1: the group is not
asked). Each distinct fingerprint gets its own thresholds from a dynamic program over the probes and candidates they would
bring, estimated from a histogram of all values of each group. It then asks the index for the values it allows, and
candidates are verified on all bits. How many groups there are follows the number of fingerprints: wider groups have more
values to ask for and fewer fingerprints to each.

What remains are fingerprints in real clusters, where any thresholds bring too many candidates. They are joined among each
other exactly by their one-bit variants: two fingerprints at distance 2 or less share a variant, and no more than 65 share
one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.components import components
from schemaloom.llm.shared import lookup, staged
from schemaloom.shipping import ship

SHINGLE, DISTANCE, BITS = 3, 2, 64
#: Most cells of a group's histogram; probes and candidates a fingerprint may expect before it counts as dense.
CELLS, DENSE = 1 << 20, 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half the hashes of all shingles of the A-Z-lower-cased words; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in joined), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at:at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long) per row of `docs`."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(printed, "doc_id long, text_hash long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def together(distinct: DataFrame) -> np.ndarray:
    """How many fingerprints have both of two bits set, for all pairs of bits (64 x 64), and on the diagonal each bit."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            bits = _bits(b.column(0).to_numpy()).astype(np.float32)
            grams += np.rint(bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(grams.ravel())], ["i", "n"])

    sums = distinct.select("fp").mapInArrow(counted, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()  # 4096 rows
    out = np.zeros(BITS * BITS, np.int64)
    for r in sums:
        out[r["i"]] = r["n"]
    return out.reshape(BITS, BITS)


def group_bits(both: np.ndarray, total: int, groups: int) -> list[list[int]]:
    """Groups of equal size, each grown from the bit with the strongest ties by the bit most correlated to the group."""
    p = np.diag(both) / max(1, total)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    ties = np.abs(both / max(1, total) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(ties, 0)
    left, out = set(range(BITS)), []
    for g in range(groups):
        size = (BITS - sum(map(len, out))) // (groups - g)
        mine = [max(sorted(left), key=lambda b: ties[b, sorted(left)].sum())]
        left.discard(mine[0])
        while len(mine) < size:
            mine.append(max(sorted(left), key=lambda b: ties[b, mine].sum()))
            left.discard(mine[-1])
        out.append(sorted(mine))
    return out


def values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of one group as a number."""
    f = np.ascontiguousarray(fp).view(np.uint64)
    out = np.zeros(len(f), np.uint64)
    for i, b in enumerate(bits):
        out |= ((f >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def even_cost(total: int, groups: int, distance: int) -> float:
    """Probes and candidates of one fingerprint among `total` evenly spread ones, thresholds being as equal as they can."""
    size = BITS / groups
    steps = [(distance + 1) // groups + (g < (distance + 1) % groups) for g in range(groups)]  # above -1
    return sum(sum(comb(int(size), e) for e in range(s)) * (1 + total / 2 ** size) for s in steps)


def group_count(total: int, distance: int = DISTANCE) -> int:
    """The number of groups that is cheapest for `total` fingerprints."""
    return min(range(1, distance + 2), key=lambda g: even_cost(total, g, distance))


def cell_count(total: int, most: int = CELLS) -> int:
    """Cells of a group's histogram: two for each fingerprint, as a power of two."""
    return min(most, max(1 << 12, 1 << (2 * total).bit_length()))


def cell(value: np.ndarray, bits: int, cells: int) -> np.ndarray:
    """The cell of a value of `bits` bits: its own if there are enough, else by a hash that mixes all bits."""
    if 1 << bits <= cells:
        return value.astype(np.int64)
    x = value.astype(np.uint64)
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.int64)


@dataclass
class Histogram:
    """Fingerprints per cell of each group's values: len(groups) x cells numbers, however many fingerprints."""
    groups: list[list[int]]
    counts: np.ndarray
    total: int

    def expected(self, g: int, value: np.ndarray) -> np.ndarray:
        """Fingerprints with that value in group `g`. Where values share cells, a cell counts by what it holds beyond chance."""
        bits, cells = len(self.groups[g]), self.counts.shape[1]
        held = self.counts[g][cell(value, bits, cells)].astype(float)
        if 1 << bits <= cells:
            return held
        chance = self.total / cells
        return self.total / 2.0 ** bits + np.maximum(0.0, held - chance - 3 * np.sqrt(chance))


def histogram(distinct: DataFrame, groups: list[list[int]], total: int) -> Histogram:
    cells = cell_count(total)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            at, n = np.unique(np.concatenate([cell(values(fp, g), len(g), cells) + i * cells for i, g in enumerate(groups)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n.astype(np.int64))], ["cell", "n"])

    sums = distinct.select("fp").mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").cast("int").alias("n")).toArrow()
    out = np.zeros(len(groups) * cells, np.int32)
    out[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return Histogram(groups, out.reshape(len(groups), cells), total)


def costs(fp: np.ndarray, h: Histogram, distance: int, above: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Least cost and thresholds per fingerprint (see `allocate`), probes and candidates being what costs.

    Thresholds of 2 ask for hundreds of values each; they are priced only for fingerprints whose cost without them exceeds
    both that number and `above`.
    """
    out = np.zeros((len(fp), len(h.groups), distance + 2))
    dear = np.inf
    for g, bits in enumerate(h.groups):
        v = values(fp, bits)
        at = h.expected(g, v)
        out[:, g, 1] = at + 1
        if distance >= 1:
            out[:, g, 2] = at + 1 + len(bits) + sum(h.expected(g, v ^ np.uint64(1 << b)) for b in range(len(bits)))
        if distance >= 2:
            out[:, g, 3] = np.inf
            dear = min(dear, 1 + len(bits) + comb(len(bits), 2))
    best, thresholds = allocate(out, distance)
    again = np.flatnonzero(best > max(dear, above))
    if len(again):
        for g, bits in enumerate(h.groups):
            v = values(fp[again], bits)
            pairs = (h.expected(g, v ^ np.uint64(1 << b | 1 << c)) for b in range(len(bits)) for c in range(b))
            out[again, g, 3] = out[again, g, 2] + comb(len(bits), 2) + sum(pairs)
        best[again], thresholds[again] = allocate(out[again], distance)
    return best, thresholds


def allocate(cost: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Least cost and thresholds per row, thresholds adding up to distance - groups + 1, by dynamic programming."""
    rows, groups, options = cost.shape
    goal = distance + 1  # in steps above -1, over all groups
    best = np.full((rows, goal + 1), np.inf)
    best[:, 0] = 0
    took = np.zeros((groups, rows, goal + 1), np.int64)
    for g in range(groups):
        new = np.full_like(best, np.inf)
        for step in range(min(options - 1, goal) + 1):
            for s in range(step, goal + 1):
                c = best[:, s - step] + cost[:, g, step]
                better = c < new[:, s]
                new[better, s], took[g][better, s] = c[better], step
        best = new
    at, out = np.full(rows, goal), np.empty((rows, groups), np.int64)
    for g in range(groups - 1, -1, -1):
        out[:, g] = took[g][np.arange(rows), at] - 1
        at = at - took[g][np.arange(rows), at]
    return best[:, goal], out


def _asked(distinct: DataFrame, h: Histogram, distance: int, dense: int) -> DataFrame:
    """Rows (kind, part, value, fp), written: kind 0 the index, 1 a value asked for, 2 a one-bit variant of a dense fingerprint."""
    shared = distinct.sparkSession.sparkContext.broadcast(h)  # len(groups) x CELLS numbers at most

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                fp = whole.column(0).slice(at, 2048).to_numpy()
                cost, thresholds = costs(fp, h, distance, dense)
                hot = cost > dense
                out = []
                for g, bits in enumerate(h.groups):
                    v = values(fp, bits)
                    # no fingerprint asks for a value that alone is expected above the limit
                    held = h.expected(g, v) <= dense
                    out.append((0, g, v[held], fp[held]))
                    for e in range(distance + 1):
                        ask = ~hot & (thresholds[:, g] >= e)
                        if ask.any():
                            out += [(1, g, v[ask] ^ np.uint64(m), fp[ask]) for m in _masks(len(bits), e)]
                f = fp[hot]
                out += [(2, -1, f.view(np.uint64), f), *((2, -1, f.view(np.uint64) ^ np.uint64(1 << b), f) for b in range(BITS))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.full(len(x[2]), x[i], np.int32) for x in out])) for i in (0, 1)]
                    + [pa.array(np.concatenate([x[2] for x in out]).view(np.int64)), pa.array(np.concatenate([x[3] for x in out]))],
                    ["kind", "part", "value", "fp"])

    out = staged(distinct.select("fp").mapInArrow(probes, "kind int, part int, value long, fp long"), "kind")
    shared.destroy()
    return out


def _masks(bits: int, flips: int) -> list[int]:
    """Numbers with `flips` (0 to 2) of `bits` bits set."""
    one = [1 << b for b in range(bits)]
    return [0] if flips == 0 else one if flips == 1 else [x | y for i, x in enumerate(one) for y in one[:i]]


def near_pairs(distinct: DataFrame, distance: int = DISTANCE, groups: int | None = None, dense: int = DENSE) -> DataFrame:
    """Links (a < b) that join all of `distinct`'s fingerprints at most `distance` <= 2 bits apart.

    Every pair with a fingerprint that is not dense is there. Dense ones are linked to the least that shares a variant with
    them, which leaves out pairs that are linked through it, and no others. groups: None for what suits their number.
    """
    if distance != 2:
        raise ValueError("the variants of dense fingerprints are made for a distance of 2")
    total = distinct.count()
    parts = group_bits(together(distinct), total, groups or group_count(total, distance))
    asked = _asked(distinct, histogram(distinct, parts, total), distance, dense)
    index = asked.where("kind = 0").select("part", "value", F.col("fp").alias("a"))
    probes = asked.where("kind = 1").select("part", "value", F.col("fp").alias("b"))
    sparse = (probes.join(index, ["part", "value"]).where("a <> b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
              .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    packs = asked.where("kind = 2").groupBy("value").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")  # 65 at most
    denser = packs.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return sparse.unionByName(denser).distinct()


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, text_hash, fingerprint (16 hex digits), component_id (least id reachable over links), root per row of `docs`.

    Null and wordless texts have fingerprint zero and are linked like others. Rows without an id keep a null component
    unless a row with one is linked to them. Repeated rows are in one component. component_id is no key of the components:
    it is null for all without an id, and an id with several texts may name two. `root`, the least fingerprint, is one.
    """
    rows = staged(fingerprints(docs, doc_id, text, shingle))
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    links = staged(near_pairs(distinct.select("fp"), distance))
    label = components(links)
    # fingerprints of a component agree on the least id below any of them
    labelled = staged(distinct.join(label, distinct.fp == label.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node"))
    roots = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = staged(lookup(labelled, roots, ["root"], "members", labelled.count(), "inner").select("fp", "root", "component_id", "n"))
    return lookup(rows, named, ["fp"], "n", rows.count(), "inner").select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")
