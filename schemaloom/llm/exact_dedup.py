"""Exact dedup against a historical corpus through a minimal perfect hash over its distinct digests.

The index is cut into buckets by digest prefix. In each bucket every digest is sent to a slot of its own by hash and
displace: digests are grouped, and each group gets the first displacement that puts its members into free slots. A slot
holds the full digest and the locator of its winner. A new digest asks the one slot its hash names and is a member only if
all bytes agree; nonmembers are grouped among themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.shared import lookup, staged
from schemaloom.shipping import ship

#: Digests in a bucket of the index, on average; digests in a group that shares a displacement.
BUCKET, GROUP = 2000, 4


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", history: Column | None = None) -> DataFrame:
    """doc_id, digest (SHA-256 of the text in UTF-8, A-Z lower-cased; null counts as empty), old. Any row order."""
    ship(docs.sparkSession)
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"),
                      F.coalesce(history if history is not None else F.lit(False), F.lit(False)).alias("old"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [hashlib.sha256((x.as_py() or b"").lower()).digest() for x in b.column(1)]  # bytes.lower: A-Z only
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2)], ["doc_id", "digest", "old"])

    return raw.mapInArrow(hashed, "doc_id long, digest binary, old boolean")


def _places(digest: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of digests as rows of four 64-bit words: the group, and two words that a displacement mixes."""
    return (digest[:, 1] % np.uint64(groups)).astype(np.int64), digest[:, 2], digest[:, 3]


def _slots(a: np.ndarray, b: np.ndarray, displacement, size: int) -> np.ndarray:
    d = np.asarray(displacement, dtype=np.uint64)
    x = a + d * (b | np.uint64(1))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def build_mph(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacement of each group, slot of each digest). `digest`: distinct, one row of four 64-bit words each."""
    size = len(digest)
    groups = max(1, -(-size // GROUP))
    group, a, b = _places(digest, groups)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(groups + 1))
    free, displacement, slot = np.ones(size, bool), np.zeros(groups, np.uint32), np.empty(size, np.int64)
    for g in np.argsort(starts[:-1] - starts[1:], kind="stable"):  # large groups first
        mine = order[starts[g]:starts[g + 1]]
        if not len(mine):
            continue
        first = 0
        while True:  # 256 displacements at a time
            tried = np.arange(first, first + 256, dtype=np.uint64)[:, None]
            s = _slots(a[mine][None, :], b[mine][None, :], tried, size)
            ok = free[s].all(axis=1)
            if len(mine) > 1:
                t = np.sort(s, axis=1)
                ok &= (t[:, 1:] != t[:, :-1]).all(axis=1)
            if ok.any():
                k = int(ok.argmax())
                displacement[g], slot[mine] = first + k, s[k]
                free[s[k]] = False
                break
            first += 256
    return displacement, slot


def _words(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u8").reshape(-1, 4)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """`history` (digest, winner, n; distinct digests) as one row per bucket: displacements and the slots' contents."""

    def built(key: tuple[int, ...], t: pd.DataFrame) -> pd.DataFrame:
        displacement, slot = build_mph(_words(t["digest"]))
        back = np.argsort(slot)
        return pd.DataFrame({"bucket": [key[0]], "displacement": [displacement.tobytes()],
                             "digests": [b"".join(t["digest"].to_numpy()[back])],
                             "winners": [t["winner"].to_numpy(np.int64)[back].tobytes()], "sizes": [t["n"].to_numpy(np.int64)[back].tobytes()]})

    return (history.withColumn("bucket", _bucket(buckets)).groupBy("bucket")
            .applyInPandas(built, "bucket long, displacement binary, digests binary, winners binary, sizes binary"))


def probe(index: DataFrame, batch: DataFrame, buckets: int) -> DataFrame:
    """`batch` (digest, winner, n; distinct) with member, old_winner and old_n from the index."""

    def probed(t: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        out = t[["digest", "winner", "n"]].copy()
        member, old, size = np.zeros(len(t), bool), np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        if len(i) and len(t):
            row = i.iloc[0]
            held = np.frombuffer(row["digests"], dtype="<u8").reshape(-1, 4)
            displacement = np.frombuffer(row["displacement"], np.uint32)
            asked = _words(t["digest"])
            group, a, b = _places(asked, len(displacement))
            slot = _slots(a, b, displacement[group], len(held))
            member = (held[slot] == asked).all(axis=1)
            old = np.where(member, np.frombuffer(row["winners"], np.int64)[slot], 0)
            size = np.where(member, np.frombuffer(row["sizes"], np.int64)[slot], 0)
        out["member"], out["old_winner"], out["old_n"] = member, old, size
        return out

    return (batch.withColumn("bucket", _bucket(buckets)).groupBy("bucket").cogroup(index.groupBy("bucket"))
            .applyInPandas(probed, "digest binary, winner long, n long, member boolean, old_winner long, old_n long"))


def exact_dedup(docs: DataFrame, history: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, in_history for every row of `docs`.

    history: which rows are the historical corpus. Equal texts form one group across both parts, and the row with the
    largest id stays. A null id counts as smaller than all others; of repeated rows with the same id and text the id
    stays, so each of them is marked kept. in_history: the text is in the historical part.
    """
    rows = staged(digests(docs, doc_id, text, history))
    grouped = [F.max(F.coalesce("doc_id", F.lit(-(2**63)))).alias("winner"), F.count("*").alias("n")]
    old = staged(rows.where("old").groupBy("digest").agg(*grouped))
    buckets = max(1, -(-old.count() // BUCKET))
    index = staged(build_index(old, buckets))
    asked = staged(probe(index, rows.where(~F.col("old")).groupBy("digest").agg(*grouped), buckets))
    members = asked.where("member").select("digest", F.greatest("winner", "old_winner").alias("winner"), (F.col("n") + F.col("old_n")).alias("n"))
    others = asked.where(~F.col("member")).select("digest", "winner", "n")
    untouched = old.join(members.select("digest"), "digest", "left_anti")
    groups = (members.withColumn("known", F.lit(True)).unionByName(others.withColumn("known", F.lit(False)))
              .unionByName(untouched.withColumn("known", F.lit(True))))
    found = lookup(rows, groups.withColumn("group_size", F.col("n")), ["digest"], "n", rows.count(), "inner")
    winner = F.when(F.col("winner") != -(2**63), F.col("winner"))
    return found.select("doc_id", winner.alias("keep_id"), "group_size", winner.eqNullSafe(F.col("doc_id")).alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256"), F.col("known").alias("in_history"))
