"""Legacy archive converter: ARC files, version 1 and 2, to WARC files.

An ARC file begins with a filedesc record that names its version, and the version says which fields a record's header
line has. Bodies are taken by declared length. Each ARC file becomes one WARC file: identifiers, timestamps, types and
digests are made from the header line and the payload. Archives are written by Spark's text writer, whose line separator
is the format's record end, one row to a file; so they lie in any store that Spark reaches.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.shared import lookup, staged, workspace
from schemaloom.shipping import ship

#: Bytes after which an archive is closed, before compression. Rounded up to whole records.
ARCHIVE = 8 << 20
#: Fields of a record's header line by ARC version (fixed values of the format).
FIELDS = {1: ("url", "ip", "date", "mime", "length"),
          2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "file", "length")}
FIELD_NAMES = {1: "URL IP-address Archive-date Content-type Archive-length",
               2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
FETCHED, IP = "20240101000000", "0.0.0.0"
ARC_END, WARC_END = "\n", "\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _token(s: str | None) -> str:
    """A header line's field: blanks and line ends percent-encoded, - for nothing."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s or "") or "-"


def arc_record(version: int, url: str, date: str, mime: str, content: bytes, ip: str = IP) -> bytes:
    tail = [str(len(content))] if version == 1 else ["200", "-", "-", "0", "-", str(len(content))]
    return " ".join([_token(url), ip, date, _token(mime), *tail]).encode("utf-8", "surrogatepass") + b"\n" + content


def arc_head(version: int) -> bytes:
    about = f"{version} 0 schemaloom\n{FIELD_NAMES[version]}\n".encode()
    return arc_record(1, "filedesc://legacy.arc", FETCHED, "text/plain", about)


def arc_records(raw: bytes) -> Iterator[dict]:
    """The records of an ARC file, filedesc first. A broken header line or a short body raises ValueError.

    Only the first record can be the file's `head`; later ones with such a url are records like others.
    """
    at, version, first = 0, 1, True
    while at < len(raw):
        if raw[at:at + 1] in b"\r\n":
            at += 1
            continue
        end = raw.find(b"\n", at)
        end = len(raw) if end < 0 else end
        line = raw[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        head = first and line[0].startswith("filedesc:")
        names = FIELDS[1] if head and len(line) == len(FIELDS[1]) else FIELDS[version]
        if len(line) != len(names) or not line[-1].isdigit():
            raise ValueError(f"no ARC header of version {version} at byte {at}")
        record = dict(zip(names, line)) | {"start": at}
        body = raw[end + 1:end + 1 + int(record["length"])]
        if len(body) < int(record["length"]):
            raise ValueError(f"the record at byte {at} declares {record['length']} bytes and has {len(body)}")
        if head:
            version = int(body.split(b" ", 1)[0])
        yield record | {"content": body, "version": version, "head": head}
        at, first = end + 1 + len(body), False


def http_parts(content: bytes) -> tuple[dict[str, str], bytes | None]:
    """(header fields in lower case, payload); payload None if the content is no HTTP response."""
    if not content.startswith(b"HTTP/"):
        return {}, None
    head, found, payload = content.partition(b"\r\n\r\n")
    fields = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in fields}, payload if found else b""


def warc_record(record: dict, refers: dict | None) -> bytes:
    """The WARC equivalent of an ARC record; a revisit of `refers` (page_id, url, date) if given."""
    content, fields, payload = record["content"], *http_parts(record["content"])
    url, date = record["url"], iso(record["date"])
    if record["head"]:
        kind, mime, block = "warcinfo", "application/warc-fields", b"software: schemaloom\r\nformat: WARC File Format 1.1\r\n"
    elif payload is None:
        kind, mime, block = ("response" if url.startswith("dns:") else "resource"), record["mime"], content
    elif refers:
        kind, mime, block = "revisit", "application/http; msgtype=response", content[:len(content) - len(payload)]
    else:
        kind, mime, block = "response", "application/http; msgtype=response", content
    digest = payload_digest(content if payload is None else payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {digest} {fields.get('x-page-id', '')} {record['start']}")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if kind != "warcinfo":
        head += [f"WARC-Target-URI: {url}", f"WARC-IP-Address: {record['ip']}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers:
        head += [f"X-Payload-Length: {len(payload)}"]  # the block of a revisit has no payload
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To-Target-URI: {refers['url']}", f"WARC-Refers-To-Date: {iso(refers['date'])}"]
        head += [f"WARC-Refers-To-Page: {refers['page_id']}"] if refers["page_id"] is not None else []
    head += [f"WARC-Block-Digest: sha1:{payload_digest(block)}", f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block


def iso(date: str) -> str:
    """A 14-digit date (shorter ones are filled up) as WARC has it."""
    d = (re.sub(r"\D", "", date) + "19700101000000"[len(re.sub(r"\D", "", date)):])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def warc_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a WARC file, by declared length."""
    at = 0
    while at < len(raw):
        if raw[at:at + 1] in b"\r\n":
            at += 1
            continue
        end = raw.find(b"\r\n\r\n", at)
        if not raw.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC header at byte {at}")
        fields = (x.partition(":") for x in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        head = {k.strip().lower(): v.strip() for k, _, v in fields}
        block = raw[end + 4:end + 4 + int(head["content-length"])]
        if len(block) < int(head["content-length"]):
            raise ValueError(f"the record at byte {at} is cut off")
        yield head, block
        at = end + 4 + len(block)


def _unzipped(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def _write(archives: DataFrame, folder: str, end: str) -> None:
    """`archives` (body: binary), one file per row. The writer adds the last record's end."""
    (archives.select(F.col("body").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
     .option("lineSep", end).option("compression", "gzip").text(folder))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content. An archive is one row, bounded by the size at which archives are closed and one record."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")


def write_arcs(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
               archive: int = ARCHIVE, date: str = FETCHED) -> None:
    """Pages as ARC files; versions 1 and 2 take turns. The page's id is a field of the HTTP header."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).cast("binary").alias("html"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, held, size = 1, [], 0
        one = lambda: pa.RecordBatch.from_arrays([pa.array([b"\n".join([arc_head(version), *held])], pa.binary())], ["body"])
        for b in batches:
            for i, u, h in zip(*b.columns):
                i, payload = i.as_py(), h.as_py() or b""
                head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
                head += [f"X-Page-Id: {i}"] if i is not None else []
                held.append(arc_record(version, u.as_py(), date, "text/html", "\r\n".join(head).encode() + b"\r\n\r\n" + payload))
                size += len(held[-1])
                if size >= archive:
                    yield one()
                    version, held, size = 3 - version, [], 0
        if held:
            yield one()

    _write(rows.mapInArrow(packed, "body binary"), folder, ARC_END)


def arc_index(files: DataFrame) -> DataFrame:
    """path, start, page_id, url, date, payload_bytes, payload_digest of the records that are HTTP responses."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(*b.columns):
                out = []
                for r in arc_records(_unzipped(raw.as_py())):
                    fields, payload = http_parts(r["content"])
                    if payload is not None:
                        i = fields.get("x-page-id")
                        out.append((path.as_py(), r["start"], int(i) if i else None, r["url"], r["date"], len(payload), payload_digest(payload)))
                if out:
                    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                     ["path", "start", "page_id", "url", "date", "payload_bytes", "payload_digest"])

    return files.mapInArrow(listed, "path string, start long, page_id long, url string, date string, payload_bytes long, payload_digest string")


def revisits(index: DataFrame, least: int = 0) -> DataFrame:
    """The records of `index` that repeat an earlier payload of at least `least` bytes, with what they refer to."""
    order = F.struct(F.coalesce("page_id", F.lit(2**63 - 1)).alias("o"), "path", "start", "page_id", "url", "date")
    firsts = (index.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
              .agg(F.min(order).alias("refers"), F.count("*").alias("n")).where("n > 1"))
    return (lookup(index, firsts, ["payload_digest", "payload_bytes"], "n", index.count(), "inner")
            .where((F.col("path") != F.col("refers.path")) | (F.col("start") != F.col("refers.start")))
            .select("path", "start", "refers.page_id", "refers.url", "refers.date"))


def convert(files: DataFrame, repeats: DataFrame, folder: str) -> None:
    """Each ARC file as a WARC file below `folder`; the records in `repeats` become revisits."""
    per_file = repeats.groupBy("path").agg(F.collect_list(F.struct("start", "page_id", "url", "date")).alias("repeats"))

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, again in zip(*b.columns):
                refers = {x["start"]: x for x in again.as_py() or []}
                out = [warc_record(r, refers.get(r["start"])) for r in arc_records(_unzipped(raw.as_py()))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(out)], pa.binary())], ["body"])

    _write(files.join(per_file, "path", "left").select("content", "repeats").mapInArrow(converted, "body binary"), folder, WARC_END)


def read_warcs(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id, intact of the HTTP records."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                out = []
                for head, block in warc_records(_unzipped(raw.as_py())):
                    fields, payload = http_parts(block)
                    if payload is None:
                        continue
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    size = len(payload) if kind == "response" else int(head["x-payload-length"])
                    i, to = fields.get("x-page-id"), head.get("warc-refers-to-page")
                    intact = head["warc-block-digest"] == f"sha1:{payload_digest(block)}" and (kind != "response" or payload_digest(payload) == digest)
                    out.append((int(i) if i else None, size, digest, kind, int(to) if to else None, head.get("warc-target-uri"), head["warc-record-id"], intact))
                if out:
                    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "intact"]
    return files.select("content").mapInArrow(listed, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                                      "refers_to long, url string, record_id string, intact boolean")


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0,
                       archive: int = ARCHIVE) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back; one row per row of `pages`.

    Null html is an empty payload. Of repeated rows with the least id of their payload one is the response. A null id
    comes after all others and gives null refers_to. Url blanks and line ends are percent-encoded; a null url is "-".
    """
    spark = pages.sparkSession
    ship(spark)
    folder = workspace(spark)
    write_arcs(pages, f"{folder}/arc", page_id, url, html, archive)
    arcs = read_files(spark, f"{folder}/arc")
    convert(arcs, revisits(staged(arc_index(arcs)), least), f"{folder}/warc")
    return read_warcs(read_files(spark, f"{folder}/warc"))
