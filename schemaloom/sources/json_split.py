"""Large JSON arrays read by many tasks: a file is scanned in byte ranges, and nesting is carried from range to range.

Spark's text reader cuts a file into ranges and, with `}` as line separator, a range into fragments that end with a closing
brace. One pass sums up each range without knowing how it begins: inside a string or outside, and at what depth. Of the two
beginnings exactly one is outside a string at any place, so one scan serves both. A fold over a file's ranges, a row each,
then says how every range begins and at which item. The second pass cuts items out of the fragments; an item that reaches
across ranges comes in pieces, which are put together by item.

Files are UTF-8. An item is a row and must fit into one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.shipping import ship
from schemaloom.sources.sinks import shared_folder, staged

OPEN, CLOSE, COMMA, END = b"[{", b"]}", ord(","), ord("}")
_OTHERS = bytes(b for b in range(256) if b not in b"[]{},")
_ESCAPED = re.compile(rb"(?s)\\.")
_BLANK = b" \t\r\n"
_TOKEN = re.compile(rb'(?s)"(?:[^"\\]|\\.|\\\Z)*(?:"|\Z)|[\[\]{}]')
_MARK = b"\xef\xbb\xbf"


def fragments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value (binary, without the brace that ends it), path, start (of the byte range); ranges are in order inside a task."""
    return spark.read.option("lineSep", "}").text(paths).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


class Summary:
    """One range, for both ways in which it can begin: 0 outside a string, 1 inside. Depths count from the range's beginning."""

    def __init__(self):
        self.flips, self.depth = 0, [0, 0]
        self.commas: list[dict[int, int]] = [{}, {}]  # how many at a depth
        self.closed: list[dict[int, int]] = [{}, {}]  # how often a closing bracket led to a depth
        self.first = self.last = b""

    def close(self) -> None:
        """The brace at the end of a fragment, if it is outside a string."""
        way = self.flips
        self.depth[way] -= 1
        d = self.depth[way]
        self.closed[way][d] = self.closed[way].get(d, 0) + 1

    def add(self, value: bytes) -> None:
        if not self.first:
            self.first = value.removeprefix(_MARK).lstrip(_BLANK)[:1]
        self.last = value.rstrip(_BLANK)[-1:]
        if b"\\" in value:
            value = _ESCAPED.sub(b"", value)
        way = self.flips
        for part in value.split(b'"'):
            for c in part.translate(None, _OTHERS):
                d = self.depth[way]
                if c == COMMA:
                    self.commas[way][d] = self.commas[way].get(d, 0) + 1
                elif c in OPEN:
                    self.depth[way] = d + 1
                else:
                    self.depth[way] = d - 1
                    self.closed[way][d - 1] = self.closed[way].get(d - 1, 0) + 1
            way ^= 1
        self.flips = way ^ 1  # as many flips as quotes

    def row(self, path: str, start: int) -> tuple:
        return (path, start, self.flips, *self.depth, *(list(m.items()) for m in (*self.commas, *self.closed)), self.first, self.last)


_COUNTS = "map<int,long>"
_SUMMARY = (f"path string, start long, flips int, depth0 int, depth1 int, commas0 {_COUNTS}, commas1 {_COUNTS}, closed0 {_COUNTS}, closed1 {_COUNTS}, "
            "first binary, last binary")


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes, tuple]]:
    """(key, value, row's other columns) of fragments; the key is (path, start)."""
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            yield row[1:3], row[0], row[3:]


def summaries(frags: DataFrame) -> DataFrame:
    """One row per range. The brace of its last fragment is not in it: a file's last fragment has none."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.int32(), pa.int64())
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), *((n, pa.int32()) for n in ("flips", "depth0", "depth1")),
                            *((n, kind) for n in ("commas0", "commas1", "closed0", "closed1")), ("first", pa.binary()), ("last", pa.binary())])
        out = lambda key, s: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(s.row(*key), schema)], schema=schema)
        key, now = None, None
        for here, value, _ in _by_range(batches):
            if here != key:
                if now:
                    yield out(key, now)
                key, now = here, Summary()
            else:
                now.close()
            now.add(value)
        if now:
            yield out(key, now)

    return frags.mapInArrow(scanned, _SUMMARY)


def beginnings(ranges: DataFrame) -> DataFrame:
    """(path, start, inside, depth, pos, final, whole): how each range begins, and whether its file is one whole array.

    A file's ranges are folded in one task; they are a row for every 128 MB or what the reader's split size is.
    """

    def folded(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("start")
        out, inside, depth, pos, ends, first = [], 0, 0, 0, 0, b""
        for k, r in enumerate(t.itertuples(index=False)):
            final = k == len(t) - 1
            commas, closed = dict(r.commas1 if inside else r.commas0), dict(r.closed1 if inside else r.closed0)
            out.append((r.path, r.start, inside, depth, pos, final))
            first = first or bytes(r.first)
            pos += commas.get(1 - depth, 0)
            ends += closed.get(-depth, 0)
            depth += r.depth1 if inside else r.depth0
            inside ^= r.flips
            if not final and not inside:
                depth -= 1
                ends += depth == 0
        whole = first == b"[" and bytes(t.iloc[-1]["last"]) == b"]" and depth == 0 and not inside and ends == 1
        return pd.DataFrame([(*o, whole) for o in out], columns=["path", "start", "inside", "depth", "pos", "final", "whole"])

    return ranges.groupBy("path").applyInPandas(folded, "path string, start long, inside int, depth int, pos long, final boolean, whole boolean")


class Cutter:
    """Cuts the items that are objects out of one range's fragments."""

    def __init__(self, inside: int, depth: int, pos: int):
        self.inside, self.depth, self.pos = inside, depth, pos
        # None: between items; else the fragments of the item that is open, and whether it began in this range
        self.item: list[bytes] | None = [] if depth > 1 else None
        self.begun = False

    def _structure(self, value: bytes) -> None:
        if b"\\" in value:
            value = _ESCAPED.sub(b"", value)
        for part in value.split(b'"'):
            if not self.inside:
                for c in part.translate(None, _OTHERS):
                    if c == COMMA:
                        self.pos += self.depth == 1
                    elif c in OPEN:
                        self.depth += 1
                    else:
                        self.depth -= 1
            self.inside ^= 1
        self.inside ^= 1

    def _brackets(self, value: bytes) -> Iterator[tuple[int, int]]:
        """(place, bracket) outside strings, from the state before the fragment."""
        for m in _TOKEN.finditer(b'"' + value if self.inside else value):
            if m[0][:1] != b'"':
                yield m.start() - self.inside, m[0][0]

    def _array_end(self, value: bytes) -> int:
        """Where an array among the items ends, or -1."""
        depth = self.depth
        for at, c in self._brackets(value):
            depth += 1 if c in OPEN else -1
            if depth == 1:
                return at + 1
        return -1

    def _object(self, value: bytes) -> int:
        """Where an object among the items begins, or -1."""
        depth = self.depth
        for at, c in self._brackets(value):
            if c == ord("{") and depth == 1:
                return at
            depth += 1 if c in OPEN else -1
        return -1

    def _pass(self, value: bytes, at: int) -> bytes:
        self._structure(value[:at])
        return value[at:]

    def add(self, value: bytes, brace: bool) -> bytes | None:
        """A fragment, with or without the brace that ends it. The item that ends with it, or what there is of it in this range."""
        if self.item is not None and not self.begun and (at := self._array_end(value)) >= 0:
            value, self.item = self._pass(value, at), None
        if self.item is None and (at := self._object(value)) >= 0:
            value, self.item, self.begun = self._pass(value, at), [], True
        if self.item is not None:
            self.item.append(value)
        self._structure(value)
        if brace and not self.inside:
            self.depth -= 1
            if self.depth == 1 and self.item is not None:
                done, self.item = b"}".join(self.item) + b"}", None
                return done
        return None


def _items(frags: DataFrame, begins: DataFrame) -> DataFrame:
    """path, pos, start, item (binary), begun, done: whole items, and the pieces of those that reach across ranges."""
    kinds = "path string, pos long, start long, item binary, begun boolean, done boolean"
    schema = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("start", pa.int64()), ("item", pa.binary()), ("begun", pa.bool_()), ("done", pa.bool_())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return b

        def take(key, cutter, value, brace):
            item = cutter.add(value, brace)
            if item is None:
                return 0
            out.append((key[0], cutter.pos, key[1], item, cutter.begun, True))
            cutter.begun = False
            return len(item)

        def left(key, cutter):
            """The piece of an item that goes on in the next range."""
            if cutter.item:
                out.append((key[0], cutter.pos, key[1], b"}".join(cutter.item) + b"}", cutter.begun, False))

        key, cutter, held, final = None, None, None, False
        for here, value, (inside, depth, pos, last) in _by_range(batches):
            if here != key:
                if cutter:
                    size += take(key, cutter, held, not final)
                    left(key, cutter)
                key, cutter, final = here, Cutter(inside, depth, pos), last
                if here[1] == 0:
                    value = value.removeprefix(_MARK)
            else:
                size += take(key, cutter, held, True)
            held = value
            if size > 1 << 22 or len(out) > 4096:
                yield flush()
                size = 0
        if cutter:
            take(key, cutter, held, not final)
            left(key, cutter)
        if out:
            yield flush()

    starts = begins.where("whole").drop("whole")
    return (frags.join(F.broadcast(starts), ["path", "start"])  # a row per range of the input
            .select("value", "path", "start", "inside", "depth", "pos", "final").mapInArrow(cut, kinds))


def read_array_split(spark: SparkSession, paths: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """The objects in the arrays of the files, as rows with `path` and `pos` (0-based, counting all items of the array).

    The rows are those of `json_docs.read_array`: items that are no objects are passed over; a file that is no whole array
    gives none, or an error if `strict`. Any number of tasks read one file.
    """
    ship(spark)
    frags = fragments(spark, paths)
    begins = staged(beginnings(summaries(frags)), shared_folder(spark))
    if strict and begins.where("NOT whole").limit(1).count():
        raise ValueError(f"expected JSON arrays: {begins.where('NOT whole').first()['path']}")
    items = staged(_items(frags, begins), shared_folder(spark))
    pieces = (items.where("NOT (begun AND done)").groupBy("path", "pos")  # at most two pieces a range
              .agg(F.max("begun").alias("begun"), F.array_sort(F.collect_list(F.struct("start", "item"))).alias("p"))
              .where("begun").select("path", "pos", F.concat_ws("", F.transform("p", lambda p: p["item"].cast("string"))).alias("item")))
    whole = items.where("begun AND done").select("path", "pos", F.col("item").cast("string").alias("item"))
    known = T.StructType.fromDDL(schema)
    return (whole.unionByName(pieces).select("path", F.col("pos").cast("int").alias("pos"), F.from_json("item", known).alias("read"))
            .select("path", "pos", "read.*"))
