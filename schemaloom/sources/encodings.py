"""Choosing a text encoding per file: UTF-8 if the bytes are valid, else Windows-1252, else Latin-1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Windows-1252 characters of the bytes 80-9F; five bytes have none.
CP1252 = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ",
    0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“",
    0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›",
    0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}
_LATIN = "".join(chr(b) for b in CP1252)
_WINDOWS = "".join(CP1252.values())
_UNASSIGNED = "[\x81\x8d\x8f\x90\x9d]"


def encoding_of(content: Column) -> Column:
    """'utf-8', 'cp1252' or 'latin-1'."""
    # Latin-1 maps every byte to the character of the same number, so bytes can be searched as text.
    as_latin = F.decode(content, "ISO-8859-1")
    return (F.when(F.is_valid_utf8(content.cast("string")), "utf-8")
            .when(~F.regexp_like(as_latin, F.lit(_UNASSIGNED)), "cp1252").otherwise("latin-1"))


def decode_best(content: Column) -> Column:
    """The text of a file; a byte-order mark is dropped."""
    as_latin = F.decode(content, "ISO-8859-1")
    encoding = encoding_of(content)
    return (F.when(encoding == "utf-8", F.regexp_replace(content.cast("string"), "^\ufeff", ""))
            .when(encoding == "cp1252", F.translate(as_latin, _LATIN, _WINDOWS)).otherwise(as_latin))


def read_texts(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, text), one row per file, found recursively below `paths`."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(paths).select("path", decode_best(F.col("content")).alias("text"))
