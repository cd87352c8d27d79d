"""Token ids as Arrow files whose batches hold fixed-size lists: equal-length sequences and their masks, without copying.

Documents are dealt out by ranges of doc_id and sorted inside a range; a task encodes its range in order and closes a file
after `FILE` ids, at the end of a document. A file is one Arrow IPC file: record batches of `ids` and `mask` (fixed-size
lists, one sequence a row) and `segments` (which documents lie where in the sequence). Sequence k of a file is row
k % BATCH of batch k // BATCH, and its values are a view on the file's bytes. Only a file's last sequence has padding.
Files are written by Spark's text writer, one row to a file, with the format's closing magic as the line separator; so they
lie in any store that Spark reaches, and a task that is run again replaces its files.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.shared import kept, let_go, staged, workspace
from schemaloom.shipping import ship

#: Ids in a sequence; sequences in a record batch; ids after which a file is closed, rounded up to a whole document.
LENGTH, BATCH, FILE = 2048, 256, 4 << 20
#: The id that ends a document.
END_ID = 1
#: Words that a worker remembers the ids of, twice (see `Encoder`), and the longest of them in bytes.
REMEMBERED, LONGEST = 400_000, 64
#: Fixed values of the format: how an Arrow file ends.
MAGIC = "ARROW1"
#: Words of plain letters with marks behind them. No pre-tokenizer of the kinds below joins the marks to the letters; apostrophes
#: are no such marks, and special tokens begin with <.
MARKS = "".join(map(chr, [*range(0x21, 0x27), *range(0x28, 0x30), 0x3A, 0x3B, 0x3D, 0x3F, 0x40, *range(0x5B, 0x61), *range(0x7B, 0x7F)]))
PLAIN = re.compile(f"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(MARKS)}]*)")
_MARKS = MARKS.encode()
#: Fixed value: a split that keeps letters, single digits and runs of other signs apart and drops white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary_file(name: str) -> str:
    """The place of a public tokenizer's file, for the driver to read."""
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: For str.translate, of bytes read as Latin-1.
BYTE_LEVEL = byte_alphabet()


def byte_level(text: str) -> str:
    return text.encode().decode("latin-1").translate(BYTE_LEVEL)


class Encoder:
    """Ids of whole texts through the tokenizers library, as bytes of little-endian unsigned integers.

    If the tokenizer drops white space between words (`by_word`), words are encoded once and remembered, since no token
    reaches across ASCII white space then. Plain words go straight to the library's BPE model, all others through the whole
    tokenizer. Two generations of words are kept, so memory is bounded: when the younger one is full it becomes the older one.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        parts = json.loads(spec)
        steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = (steps[0].get("type") == "Split" and steps[0]["pattern"].get("Regex") == SPLIT and steps[0]["behavior"] == "Removed"
                        and steps[0]["invert"] and [x["type"] for x in steps[1:]] == ["ByteLevel"] and not steps[1]["add_prefix_space"]
                        and [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"])
        self.by_word = self.by_word and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in parts["added_tokens"])
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _library(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _stem(self, text: str) -> bytes:
        """Ids of one pre-token: plain letters in lower case, or marks."""
        found = self.stems.get(text)
        if found is None:
            if len(self.stems) > REMEMBERED:
                self.stems.clear()
            units = text if text.isascii() else byte_level(text)
            found = self.stems[text] = array(self.code, [t.id for t in self.model.tokenize(units)]).tobytes()
        return found

    def _parts(self, word: bytes) -> bytes:
        low = word.lower()  # A-Z only
        stem = low.rstrip(_MARKS)
        if stem.isalpha():  # ASCII letters only
            found = self._stem(stem.decode())
            return found if len(stem) == len(low) else found + self._stem(low[len(stem):].decode())
        plain = PLAIN.fullmatch(word.decode("utf-8", "replace"))
        if plain:
            return self._stem(plain[1].lower()) + (self._stem(plain[2]) if plain[2] else b"")
        return self._library([word])[0]

    def _learn(self, word: bytes) -> bytes:
        found = self.young.get(word)  # a word comes back that was new a moment ago
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = self._parts(word)
            if len(word) <= LONGEST:
                if len(self.young) > REMEMBERED:
                    self.old, self.young = self.young, {}
                self.young[word] = found
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return self._library(texts)
        return [self._one(text) for text in texts]

    def _one(self, text: bytes) -> bytes:
        words = text.split()  # at the six ASCII blanks
        found = list(map(self.young.get, words))
        for at in [k for k, x in enumerate(found) if x is None]:
            found[at] = self._learn(words[at])
        return b"".join(found)


class FileBuilder:
    """Collects whole documents and gives them out as the bytes of one Arrow file."""

    def __init__(self, kind: np.dtype, part: int, length: int):
        self.kind, self.part, self.length, self.no, self.offset = kind, part, length, 0, 0
        self.held: list[bytes] = []
        self.docs: list[int | None] = []
        self.ends: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> int:
        self.held.append(ids)
        self.docs.append(doc_id)
        self.ends.append((self.ends[-1] if self.ends else 0) + len(ids) // self.kind.itemsize)
        return self.ends[-1]

    def close(self) -> bytes:
        n, size = self.ends[-1], self.length
        rows = -(-n // size)
        ids = np.zeros(rows * size, self.kind)
        ids[:n] = np.frombuffer(b"".join(self.held), self.kind)
        mask = np.arange(rows * size) < n
        segments = self._segments(rows)
        value = pa.uint16() if self.kind.itemsize == 2 else pa.uint32()
        schema = pa.schema([("ids", pa.list_(value, size)), ("mask", pa.list_(pa.bool_(), size)), ("segments", segments.type)],
                           {"part": str(self.part), "no": str(self.no), "offset": str(self.offset), "tokens": str(n), "batch": str(BATCH)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, schema) as out:
            for at in range(0, rows, BATCH):
                k = min(BATCH, rows - at)
                part = slice(at * size, (at + k) * size)
                out.write_batch(pa.RecordBatch.from_arrays(
                    [pa.FixedSizeListArray.from_arrays(pa.array(ids[part]), size), pa.FixedSizeListArray.from_arrays(pa.array(mask[part]), size),
                     segments.slice(at, k)], schema=schema))
        self.no, self.offset = self.no + 1, self.offset + n
        self.held, self.docs, self.ends = [], [], []
        return sink.getvalue().to_pybytes()

    def _segments(self, rows: int) -> pa.Array:
        """Per sequence the documents in it: doc_id, head (the document begins here), at (first position) and n (ids)."""
        ends = np.array(self.ends, np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        first, last = starts // self.length, (ends - 1) // self.length
        pieces = last - first + 1
        doc = np.repeat(np.arange(len(ends)), pieces)
        row = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.maximum(starts[doc], row * self.length)
        n = np.minimum(ends[doc], (row + 1) * self.length) - begin
        ids = pa.array(self.docs, pa.int64()).take(pa.array(doc))
        items = pa.StructArray.from_arrays([ids, pa.array(begin == starts[doc]), pa.array((begin - row * self.length).astype(np.int32)), pa.array(n.astype(np.int32))],
                                           ["doc_id", "head", "at", "n"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), items)


def write_tokens(docs: DataFrame, spec: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, length: int = LENGTH,
                 file_ids: int = FILE) -> None:
    """Writes the ids of all documents of `docs`, each followed by `end_id`, as Arrow files below `folder`.

    spec: the tokenizer's JSON text. Order: doc_id, nulls first, then a hash of the text; equal rows follow one another.
    Null texts count as empty. Only `doc_id` and `text` are read, whatever other columns there are.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(spec)  # a tokenizer's file
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
                       F.xxhash64(F.col(text)).alias("h"), F.monotonically_increasing_id().alias("row"))
    # the row's number keeps an id or text that very many rows have from falling into one range
    ordered = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(shared, Encoder)
        end = np.array([end_id], encoder.kind).tobytes()
        file = FileBuilder(encoder.kind, TaskContext.get().partitionId(), length)
        one = lambda: pa.RecordBatch.from_arrays([pa.array([file.close()[:-len(MAGIC)]], pa.binary())], ["body"])
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                for i, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist())):
                    if file.add(i, ids + end) >= file_ids:
                        yield one()
        if file.docs:
            yield one()

    (ordered.mapInArrow(packed, "body binary").select(F.col("body").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("lineSep", MAGIC).text(folder))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row (path, content) per file; a file's size is bounded by `file_ids` and one document."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "content")


def open_file(content) -> pa.ipc.RecordBatchFileReader:
    """A reader over the bytes of a file, or a memory map of it; batches are views on them."""
    return pa.ipc.open_file(content if isinstance(content, pa.MemoryMappedFile) else pa.py_buffer(content))


def sequence(reader: pa.ipc.RecordBatchFileReader, k: int) -> tuple[np.ndarray, pa.Array, list[dict]]:
    """Sequence `k` of a file: ids (a view), mask, segments."""
    per = int(reader.schema.metadata[b"batch"])
    batch, at = reader.get_batch(k // per), k % per
    size = batch.schema.field("ids").type.list_size
    ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)[at * size:(at + 1) * size]
    return ids, batch.column(1).flatten().slice(at * size, size), batch.column(2)[at].as_py()


def read_sequences(files: DataFrame) -> DataFrame:
    """part, no, k, ids, mask, segments: every sequence of the files, in the order (part, no, k)."""
    ship(files.sparkSession)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(1):
                reader, k = open_file(raw.as_buffer()), 0
                for at in range(reader.num_record_batches):
                    r = reader.get_batch(at)
                    n, head = r.num_rows, reader.schema.metadata
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(head[b"part"])] * n, pa.int32()), pa.array([int(head[b"no"])] * n, pa.int32()), pa.array(range(k, k + n), pa.int32()),
                         r.column(0).cast(pa.list_(pa.int32())), r.column(1).cast(pa.list_(pa.bool_())), r.column(2)],
                        ["part", "no", "k", "ids", "mask", "segments"])
                    k += n

    return files.mapInArrow(listed, "part int, no int, k int, ids array<int>, mask array<boolean>, "
                                    "segments array<struct<doc_id: long, head: boolean, at: int, n: int>>")


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, from the files alone.

    start: ids of all documents before it. A file knows the ids before it in its range; what is added up here is one
    number per range, as many as the writing job had tasks.
    """
    ship(files.sparkSession)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            for raw in b.column(1):
                reader = open_file(raw.as_buffer())
                head, table = reader.schema.metadata, reader.read_all()
                n = int(head[b"tokens"])
                ids = np.concatenate([c.flatten().to_numpy() for c in table.column("ids").chunks])[:n]
                items = pa.concat_arrays([c.flatten() for c in table.column("segments").chunks])
                first = np.flatnonzero(items.field("head").to_numpy(zero_copy_only=False))
                sizes = np.add.reduceat(items.field("n").to_numpy().astype(np.int64), first)
                ends = np.cumsum(sizes)
                if ends[-1] != n:
                    raise ValueError(f"segments cover {ends[-1]} of {n} ids")
                sums = [zlib.crc32(ids[e - s:e].astype("<u4").tobytes()) for s, e in zip(sizes.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(head[b"part"])] * len(first), pa.int32()), items.field("doc_id").take(pa.array(first)),
                     pa.array(ends - sizes + int(head[b"offset"])), pa.array(sizes), pa.array(sums, pa.int64())],
                    ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    spark = files.sparkSession
    found = staged(files.mapInArrow(listed, "part int, doc_id long, at long, n_tokens long, ids_crc32 long"))
    base, before = [], 0
    for r in found.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # one row per range
        base.append((r["part"], before))
        before += r["n"]
    return (found.join(F.broadcast(spark.createDataFrame(base, "part int, base long")), "part")
            .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def round_trip(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, file_ids: int = FILE) -> DataFrame:
    """`write_tokens` and `read_documents`: one row per row of `docs`. An empty table gives no rows."""
    folder = f"{workspace(docs.sparkSession)}/tokens"
    write_tokens(docs, spec, folder, doc_id, text, length=length, file_ids=file_ids)
    return read_documents(read_files(docs.sparkSession, folder))
