"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces and a single-pass Viterbi.

The automaton reports, position by position, all pieces that end there (its output links are followed in C), and the pass
relaxes the best segmentation that ends there. For unigram models the best is the highest sum of scores. For BPE models
scores are ranks of merges, not probabilities: a segmentation counts only if each two neighbours are what merging their
joined text gives. Exactly one such segmentation exists per prefix, and it is the one that merging finds; so what the pass
relaxes there is whether a prefix is reached at all, and scores decide inside the neighbours' merges.

The space mark itself in a text is written as bytes, where the vocabulary has them, and so comes back as it was; the library
would read it as a space. Ids of all other texts are the library's.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.shared import kept
from schemaloom.shipping import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units (a word with the space before it) and neighbours that a task remembers, and the longest unit remembered.
REMEMBERED, LONGEST = 300_000, 64
#: Plain letters, as a class of a regular expression, and the marks that may be cut off behind them.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!,.:;?"


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[str]  # normal, byte, unknown or control
    bpe: bool
    dummy_prefix: bool


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
        yield key >> 3, raw[at:at + size]
        at += size


#: Fixed values of the format: numbers of the fields and of the model types that are read here.
TRAINER, NORMALIZER, MODEL_TYPE, CHARSMAP, DUMMY_PREFIX, REMOVE_SPACES = 2, 3, 3, 2, 3, 4
UNIGRAM, BPE = 1, 2


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """The pieces of a model file, its type and whether texts get a space in front, read by the driver.

    The model has to be a unigram or BPE model that does not rewrite text: identity normalisation, extra spaces kept.
    """
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    parts = dict(_fields(m.serialized_model_proto()))  # of repeated fields the last; these two are not
    trainer, normalizer = dict(_fields(parts.get(TRAINER, b""))), dict(_fields(parts.get(NORMALIZER, b"")))
    kind_of_model = trainer.get(MODEL_TYPE, UNIGRAM)
    if kind_of_model not in (UNIGRAM, BPE) or normalizer.get(CHARSMAP) or normalizer.get(REMOVE_SPACES, 1):
        raise ValueError(f"{path}: not a unigram or BPE model that leaves texts as they are")
    ids = range(m.get_piece_size())
    kind = lambda i: "byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else "control" if m.is_control(i) else "normal"
    return Vocabulary([m.id_to_piece(i) for i in ids], [m.get_score(i) for i in ids], [kind(i) for i in ids], kind_of_model == BPE,
                      bool(normalizer.get(DUMMY_PREFIX, 1)))


class Codec:
    def __init__(self, v: Vocabulary):
        self.v = v
        self.ids = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == "normal" and p}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(v.pieces) if v.kinds[i] == "byte"}
        self.unknown = v.kinds.index("unknown") if "unknown" in v.kinds else 0
        self.floor = min(v.scores, default=0.0) - 10.0  # of a character without a piece
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p), v.scores[i]))
        self.automaton.make_automaton()
        # text may be cut where no piece reaches across
        across = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        line = "\n" if not any("\n" in p for p in self.ids) else ""
        joined = set(re.findall(f"(?<=[{LETTERS}])[{MARKS}]", "\0".join(self.ids)))
        apart = "".join(c for c in MARKS if c not in joined)
        word = f"(?:[{LETTERS}]+(?=[{apart}])|[^{SPACE}{line}]+)" if apart else f"[^{SPACE}{line}]+"
        self.units = re.compile(r"(?s).+") if across else re.compile(f"{SPACE}*{word}|{SPACE}+" + (f"|{line}" if line else ""))
        self.single = {p for p in self.ids if len(p) == 1}
        self.seen: dict[str, array] = {}
        self.before: dict[str, array] = {}  # what was remembered before `seen` was last full
        self.pairs: dict[tuple[str, str], bool] = {}  # of texts, for units with characters that are no pieces
        self.follows: dict[int, bool] = {}  # of ids
        text = {"byte": lambda p: bytes([int(p[3:5], 16)]), "normal": lambda p: p.replace(SPACE, " ").encode("utf-8", "surrogatepass"),
                "unknown": lambda p: " ⁇ ".encode(), "control": lambda p: b""}
        self.raw = [text[k](p) for k, p in zip(v.kinds, v.pieces)]

    def _fallback(self, char: str) -> list[int]:
        raw = char.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if self.bytes else [self.unknown]

    def _merged(self, text: str) -> list[str]:
        """Merges neighbours, best score first and leftmost among equals, as BPE defines it. For short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.v.scores[k] > best):
                    best, at = self.v.scores[k], i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _neighbours(self, a: str, b: str) -> bool:
        """Does merging leave the border between `a` and `b` as it is, and both whole?"""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            known = self.pairs[(a, b)] = self._stay(a, b)
        return known

    def _stay(self, a: str, b: str) -> bool:
        return self._merged(a + b) == ([a, b] if a else [b])

    def _segment(self, unit: str) -> list[str]:
        """The pieces of a unit; characters without a piece come alone."""
        n = len(unit)
        score, back = [0.0] + [None] * n, [0] * (n + 1)  # back: start of the last piece
        ending: list[tuple[int, int, float]] = []
        matches = self.automaton.iter(unit)
        match = next(matches, None)
        for end in range(1, n + 1):
            ending.clear()
            while match is not None and match[0] == end - 1:
                ending.append((end - match[1][1], match[1][0], match[1][2]))
                match = next(matches, None)
            for start, _, s in ending:
                if score[start] is None:
                    continue
                if self.v.bpe:
                    if self._neighbours(unit[back[start]:start], unit[start:end]):
                        score[end], back[end] = 0.0, start
                        break
                elif score[end] is None or score[start] + s > score[end]:
                    score[end], back[end] = score[start] + s, start
            # a character without a piece of its own stands alone
            if score[end - 1] is not None and unit[end - 1] not in self.ids:
                alone = score[end - 1] + self.floor
                if score[end] is None or not self.v.bpe and alone > score[end]:
                    score[end], back[end] = alone, end - 1
        out, end = [], n
        while end:
            out.append(unit[back[end]:end])
            end = back[end]
        return out[::-1]

    def _known(self, unit: str) -> array | None:
        """`_segment` for BPE and a unit whose characters all are pieces: the same pass, over ids."""
        pieces, follows, many = self.v.pieces, self.follows, len(self.v.pieces)
        last, back = [-1] * (len(unit) + 1), [0] * (len(unit) + 1)
        for end, (i, size, _) in self.automaton.iter(unit):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - size
            a = last[start] if start else many
            if a < 0:
                continue
            pair = a * many + i
            ok = follows.get(pair)
            if ok is None:
                if len(follows) > REMEMBERED:
                    follows.clear()
                ok = follows[pair] = self._stay(pieces[a] if start else "", pieces[i])
            if ok:
                last[end + 1], back[end + 1] = i, start
        out, end = array("i"), len(unit)
        while end:
            if last[end] < 0:
                return None
            out.append(last[end])
            end = back[end]
        out.reverse()
        return out

    def _unit(self, unit: str) -> array:
        found = self.before.get(unit)
        if found is None and self.v.bpe and self.single.issuperset(unit):
            found = self._known(unit)
        if found is None:
            found = array("i")
            for p in self._segment(unit):
                i = self.ids.get(p)
                found.extend([i] if i is not None else self._fallback(p))
        if len(unit) <= LONGEST:
            if len(self.seen) > REMEMBERED:
                self.before, self.seen = self.seen, {}
            self.seen[unit] = found
        return found

    def ids_of(self, text: str) -> array:
        out = array("i")
        if not text:
            return out
        unit = self._unit
        # the space mark itself, found in a text, is written as bytes, so that it does not come back as a space
        for k, part in enumerate(text.split(SPACE) if self.bytes else [text]):
            if k:
                out.extend(self._fallback(SPACE))
            part = part.replace(" ", SPACE)
            if not k and self.v.dummy_prefix:
                part = SPACE + part
            for u in self.units.findall(part):
                out.extend(self.seen.get(u) or unit(u))
        return out

    def encode(self, text: str) -> list[int]:
        return self.ids_of(text).tolist()

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if self.v.dummy_prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def _encoded(codec: Codec, column: pa.Array) -> pa.Array:
    ids, ends, gone = array("i"), [0], []
    for t in column.to_pylist():
        if t is not None:
            ids.extend(codec.ids_of(t))
        gone.append(t is None)
        ends.append(len(ids))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)), mask=pa.array(gone, pa.bool_()))


def _decoded(codec: Codec, column: pa.Array) -> pa.Array:
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
    return pa.array([codec.decode(values[a:b].tolist()) if there else None
                     for a, b, there in zip(ends, ends[1:], column.is_valid().to_pylist())], pa.string())


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the ids of `text` in a new last column (in place of one of that name). Null texts have null ids."""
    return _mapped(docs.drop(ids), vocabulary, text, [(ids, "array<int>", _encoded)])


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`encoded` with the text of `ids` in a new last column (in place of one of that name). Null ids give null."""
    return _mapped(encoded.drop(text), vocabulary, ids, [(text, "string", _decoded)])


def _mapped(df: DataFrame, vocabulary: Vocabulary, source: str, steps: list[tuple]) -> DataFrame:
    """`df` with a new column per step (name, type, how): the first made from `source`, each other from the one before it.

    All in one pass, so a task has one worker with one codec however many steps there are.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # the model's pieces
    at, names = df.columns.index(source), [*df.columns, *(name for name, _, _ in steps)]
    out = plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))  # whatever characters the names have
    for _, kind, _ in steps:
        out = out.withColumn(f"c{len(out.columns)}", F.lit(None).cast(kind))
    ways = [how for _, _, how in steps]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(shared, Codec)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                columns, last = [*b.columns], b.column(at)
                for how in ways:
                    columns.append(last := how(codec, last))
                yield pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(columns))])

    return plain.mapInArrow(mapped, out.schema).toDF(*names)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, decoded (the text read back from the ids) per row of `docs`."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    coded = _mapped(rows, vocabulary, "text", [("ids", "array<int>", _encoded), ("decoded", "string", _decoded)])
    return coded.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "decoded")
