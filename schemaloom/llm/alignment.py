"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Each text becomes two rising arrays of byte offsets where tokens end. The comparison runs along a diagonal: at the current
shift between the two indices it compares slices that double in length while they agree and halve once they do not, so a
one-to-one stretch costs a few comparisons however long it is. Where the ends differ, the group is closed by advancing
whichever side ends first, and the shift is what the two indices differ by afterwards.

Pairs of ids that end together are counted over all texts. A text keeps its distinct pairs with their numbers, written
once; the most frequent pairs, at most `HEAVY`, go to all tasks, and the rest is joined by key.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.shared import kept, let_go, staged
from schemaloom.llm.token_files import BYTE_LEVEL, MARKS, PLAIN, byte_level
from schemaloom.shipping import ship

#: Pairs with at least this share of all links are looked up from a broadcast, so there are at most so many of them.
HEAVY = 1 << 17
#: Pieces of text that a worker remembers the tokens of (twice, see `Tokens`), and the longest of them.
REMEMBERED, LONGEST = 300_000, 48
#: Unicode white space; a space is no place to cut if one of them stands before it.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = "▁"
SPACE_UNIT = BYTE_LEVEL[0x20]
#: A plain letter with a mark behind it (see `token_files.PLAIN`).
JOINED = re.compile(f"[A-Za-zÀ-ÖØ-öø-ÿ][{re.escape(MARKS)}]")


@dataclass
class Spec:
    """Files of the two tokenizers: a byte-level BPE of the tokenizers library, a model of the sentencepiece library."""
    a: str
    b: bytes


def read_spec(a: str, b: str) -> Spec:
    """Reads both files, by the driver."""
    with open(a, encoding="utf-8") as fa, open(b, "rb") as fb:
        return Spec(fa.read(), fb.read())


#: Ids of a piece of text: of both tokenizers, as bytes; or False if the tokens of one do not join to the piece.
Ids = tuple[bytes, bytes] | bool


class Tokens:
    """Ids of both tokenizers for whole texts.

    Neither tokenizer has a token that reaches across a space with a character other than white space before it, so texts
    are cut there and the pieces' ids are remembered, in two generations of bounded size. Lines of plain words with marks
    behind them are put together from their parts: neither tokenizer joins these, and of letters and marks both keep every
    byte. A's ids of a part come straight from the library's BPE model; anything else goes through the whole tokenizers.
    """

    def __init__(self, spec: Spec):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(spec.a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=spec.b)
        self.model = self.a.model
        alphabet = {c: b for b, c in BYTE_LEVEL.items()}
        special = {t.content: t for t in self.a.get_added_tokens_decoder().values()}
        split = repr(self.a.pre_tokenizer)
        if self.a.normalizer is not None or "ByteLevel" not in split or "add_prefix_space=True" in split:
            raise ValueError("A has to be a byte-level tokenizer that leaves texts as they are")
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.raw_a = [n.encode() if n in special else bytes(alphabet[c] for c in n) for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece reaches across a space")
        # no piece of B joins marks or a line's end to a letter, and both vocabularies have every byte
        self.parts = (not any(JOINED.search(p) or "\n" in p for i, p in enumerate(pieces) if not self.b.is_byte(i)) and set(alphabet) <= set(names)
                      and sum(map(self.b.is_byte, range(len(pieces)))) == 256)
        self.lead = len(self.b.encode("a")), len(self.b.encode("\n"))
        self.size_a, self.size_b = (np.array([len(r) for r in raw], np.int64) for raw in (self.raw_a, self.raw_b))
        self.crowded = re.compile(f"[{BLANK}] ")
        self.cut = re.compile(f"(?s)(?: [^ ]*)+?(?:(?<![{BLANK}])(?= )|\\Z)")
        self.young: dict[str, Ids] = {}
        self.old: dict[str, Ids] = {}
        self.stems: dict[str, Ids] = {}

    def pieces(self, text: str) -> list[str]:
        """Space + text cut before spaces; each piece without the space it begins with."""
        if text[:1] != " " and not self.crowded.search(text):
            return text.split(" ")
        return [p[1:] for p in self.cut.findall(" " + text)]

    def _whole(self, pieces: list[str]) -> list[Ids]:
        """Ids of space + piece."""
        out = []
        both = zip(pieces, self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False), self.b.encode(pieces, num_threads=1)) if pieces else ()
        for p, a, b in both:
            raw, a, b = (" " + p).encode(), a.ids, b if p else [self.b.piece_to_id(SPACE)]  # the library adds no space to nothing
            same = b"".join([self.raw_a[i] for i in a]) == raw and b"".join([self.raw_b[i] for i in b]) == raw
            out.append(same and (array("I", a).tobytes(), array("I", b).tobytes()))
        return out

    def _parts(self, piece: str) -> list[str] | None:
        """The parts of space + piece, by their first character: space + letters, marks, line end + letters. None if there is more in it."""
        out = []
        for k, line in enumerate(piece.split("\n")):
            plain = PLAIN.fullmatch(line)
            if not plain:
                return None
            out += [" " + plain[1]] if not k else ["\n", "\n" + plain[1]]
            if plain[2]:
                out.append(plain[2])
        return out

    def _learn_parts(self, parts: list[str]) -> None:
        """A line end comes as a part of its own; letters behind one have no space and are cut off from it here."""
        head = lambda p: 0 if p[0] == " " else 1 if p == "\n" else self.lead[p[0] == "\n"]  # noqa: E731  B's ids before the part
        sent = [p[1:] if p[0] == " " else p if p[0] == "\n" else "a" + p for p in parts]
        for p, b in zip(parts, self.b.encode(sent, num_threads=1) if sent else ()):
            unit = p[1:] if p[0] == "\n" and len(p) > 1 else p
            unit = f"{SPACE_UNIT}{unit[1:]}" if p[0] == " " and p.isascii() else unit if p.isascii() and p != "\n" else byte_level(unit)
            self.stems[p] = array("I", [t.id for t in self.model.tokenize(unit)]).tobytes(), array("I", b[head(p):]).tobytes()

    def _learn(self, pieces: list[str]) -> dict[str, Ids]:
        """Ids of space + piece for pieces that the younger generation does not have."""
        out = {p: x for p in pieces if (x := self.old.get(p)) is not None}
        cut = {p: self._parts(p) if self.parts else None for p in pieces if p not in out}
        whole = [p for p, parts in cut.items() if parts is None]
        out.update(zip(whole, self._whole(whole)))
        if len(self.stems) > REMEMBERED:
            self.stems.clear()
        self._learn_parts(list({x for parts in cut.values() for x in parts or () if x not in self.stems}))
        for p, parts in cut.items():
            if parts is not None:
                ids = [self.stems[x] for x in parts]
                out[p] = ids[0] if len(ids) == 1 else (b"".join([x[0] for x in ids]), b"".join([x[1] for x in ids]))
        if len(self.young) + len(out) > REMEMBERED:
            self.old, self.young = self.young, {}
        self.young.update((p, x) for p, x in out.items() if len(p) <= LONGEST)
        return out

    def texts(self, raws: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both tokenizers; None for texts that are null, empty or not what either one's tokens join to."""
        cut = [self._cut(raw) for raw in raws]
        known = [list(map(self.young.get, pieces)) for pieces in cut]
        learnt = self._learn(list({p for pieces, ids in zip(cut, known) if None in ids for p, x in zip(pieces, ids) if x is None}))
        for pieces, ids in zip(cut, known):
            if None in ids:
                ids = [learnt[p] if x is None else x for p, x in zip(pieces, ids)]
            if not ids or False in ids:
                yield None
            else:
                yield tuple(np.frombuffer(b"".join(map(itemgetter(k), ids)), "<u4") for k in (0, 1))

    def _cut(self, raw: bytes | None) -> list[str]:
        try:
            return self.pieces(raw.decode()) if raw else []
        except UnicodeDecodeError:
            return []


def align(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """Indices of the tokens that do not end a group, on either side. Both lists rise and have the same last number."""
    inner_a, inner_b, i, j = [], [], 0, 0
    while i < len(ends_a):
        width, growing = 1, True
        while width:
            stretch = ends_a[i:i + width]
            if stretch == ends_b[j:j + width]:
                if not stretch:
                    return inner_a, inner_b
                i += len(stretch)
                j += len(stretch)
                width = width * 2 if growing else width // 2
            else:
                growing = False
                width //= 2
        if i >= len(ends_a):
            break
        x, y = ends_a[i], ends_b[j]
        while x != y:  # a group that is not one to one
            if x < y:
                inner_a.append(i)
                i += 1
                x = ends_a[i]
            else:
                inner_b.append(j)
                j += 1
                y = ends_b[j]
        i += 1
        j += 1
    return inner_a, inner_b


class Writer:
    """The text form of groups: ids of both sides in order."""

    def __init__(self, n_a: int, n_b: int):
        two = lambda n, inner, last: np.array([[f"{i}{inner}" for i in range(n)], [f"{i}{last}" for i in range(n)]], object)
        self.a, self.b = two(n_a, ",", "|"), two(n_b, ",", ";")

    def text(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """Groups joined by ;, their ids by , with | between the two sides."""
        upto_a, upto_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.concatenate([[0], upto_b[:-1]])[group_a]] = self.a[last_a.astype(np.int8), a]
        out[np.arange(len(b)) + upto_a[group_b]] = self.b[last_b.astype(np.int8), b]
        return "".join(out.tolist())[:-1]


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, np.int64)]).astype(kind)))


def _tools(spec: Spec) -> tuple[Tokens, Writer]:
    tokens = Tokens(spec)
    return tokens, Writer(len(tokens.raw_a), len(tokens.raw_b))


def links(docs: DataFrame, spec: Spec, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, codes, times per row of `docs`.

    codes: the distinct pairs that end together, a id times the size of B's vocabulary plus b id; times: how often each
    does in this text. Every token has at least one byte, so a group has exactly one link, that of its last tokens.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # the tokenizers' files
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, writer = kept(shared, _tools)
        none = np.empty(0, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                counts, hashes, codes, times = [], [], [], []
                for ids in tokens.texts(b.column(2).to_pylist()):
                    if ids is None:
                        counts.append((0, 0, 0))
                        hashes.append("")
                        codes.append(none)
                        times.append(none)
                        continue
                    one, two = ids
                    inner_a, inner_b = align(np.cumsum(tokens.size_a[one]).tolist(), np.cumsum(tokens.size_b[two]).tolist())
                    last_a, last_b = np.ones(len(one), bool), np.ones(len(two), bool)
                    last_a[inner_a], last_b[inner_b] = False, False
                    pair, n = np.unique(one[last_a].astype(np.int64) * len(tokens.raw_b) + two[last_b], return_counts=True)
                    counts.append((len(one), len(two), int(n.sum())))
                    hashes.append(hashlib.sha256(writer.text(one, two, last_a, last_b).encode()).hexdigest())
                    codes.append(pair)
                    times.append(n)
                n_a, n_b, groups = (pa.array(c, pa.int64()) for c in zip(*counts))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), n_a, n_b, groups, groups, pa.array(hashes, pa.string()), _lists(codes, np.int64), _lists(times, np.int32)],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"])

    return rows.mapInArrow(aligned, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                    "codes array<long>, times array<int>")


def pair_counts(linked: DataFrame, size_b: int) -> DataFrame:
    """code, n, best: how many links of all texts hold each pair, and whether no pair with its B id has more.

    Texts' pairs are added up per batch before they are shuffled. B ids are at most `size_b`, so their maxima are broadcast.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            code, at = np.unique(b.column(0).flatten().to_numpy(), return_inverse=True)
            n = np.bincount(at, weights=b.column(1).flatten().to_numpy(), minlength=len(code)).astype(np.int64)  # exact below 2 ** 53
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    counts = staged(linked.select("codes", "times").mapInArrow(added, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    b = F.col("code") % size_b
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return staged(counts.withColumn("b", b).join(F.broadcast(most), "b").select("code", "n", (F.col("n") == F.col("most")).alias("best")))


def alignment(docs: DataFrame, spec: Spec, doc_id: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of `docs`.

    Texts that are null, empty, or whose tokens do not join to space + text have zeros and an empty groups_sha256. Repeated
    rows are texts of their own and count each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    import sentencepiece
    size_b = sentencepiece.SentencePieceProcessor(model_proto=spec.b).get_piece_size()
    linked = staged(links(docs, spec, doc_id, text))
    counts = pair_counts(linked, size_b)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = counts.where(F.col("n") * heavy >= total).toArrow()  # at most `heavy` rows
    order = np.argsort(top.column("code").to_numpy())
    shared = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy()[order] for c in ("code", "n", "best")))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = shared.value
        for b in batches:
            mine, times = b.column("codes").flatten().to_numpy(), b.column("times").flatten().to_numpy().astype(np.int64)
            sizes = np.diff(b.column("codes").offsets.to_numpy())
            doc = np.repeat(np.arange(b.num_rows), sizes)
            at = np.minimum(np.searchsorted(code, mine), max(0, len(code) - 1))
            held = code[at] == mine if len(code) else np.zeros(len(mine), bool)
            count_sum, n_best = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(count_sum, doc[held], times[held] * n[at[held]])
            np.add.at(n_best, doc[held], times[held] * best[at[held]])
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[~held], minlength=b.num_rows))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (mine[~held], times[~held].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in plain), pa.array(count_sum), pa.array(n_best), *rest],
                                             [*plain, "count_sum", "n_best", "codes", "times"])

    plain = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    part = staged(linked.mapInArrow(summed, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                            "count_sum long, n_best long, codes array<long>, times array<int>"))
    rare = part.select("row", F.explode(F.arrays_zip("codes", "times")).alias("p")).select("row", "p.codes", "p.times")
    light = (rare.join(counts.where(F.col("n") * heavy < total), rare["codes"] == F.col("code"))
             .groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("better")))
    zero = F.lit(0)
    return (part.drop("codes", "times").join(light, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("better", zero)).alias("n_best"),
                    (F.col("count_sum") + F.coalesce("more", zero)).alias("count_sum"), "groups_sha256"))
