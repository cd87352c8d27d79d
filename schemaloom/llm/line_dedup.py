"""Line dedup: lines that many sites carry are boilerplate; each is kept where it stands first and removed elsewhere.

Site spread is counted with HyperLogLog sketches per line hash that merge in the aggregation. Sketches are only trusted
away from the threshold: lines whose estimate lies within `margin` of it get an exact count of distinct sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from schemaloom.llm.shared import HEAVY, lookup, row_key, staged, quoted

#: Sites from which on a line is boilerplate.
MIN_SITES = 10
#: log2 of a sketch's registers; the standard error is 1.04 / sqrt(2 ** LG_K) = 1.6 %.
LG_K = 12
#: Half the width of the band of exact counts as a part of the threshold: six standard errors.
MARGIN = 0.1


def _lines(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """One row per line that is not blank: row key, position, 128-bit hash of the trimmed line, site."""
    doc, text_hash = row_key(doc_id, text)
    line = F.btrim(F.col("line"), F.lit(" \t\r"))
    return (docs.select(doc.alias("doc"), text_hash.alias("text_hash"), F.col(site).alias("site"),
                        F.posexplode(F.split(text, "\n")).alias("pos", "line"))
            .where(line != "")
            .select("doc", "text_hash", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), "site"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, lg_k: int = LG_K):
    """(occurrences of lines near or above the threshold, the boilerplate lines with their first place, its rows).

    Lines that are frequent without being spread are carried along only so that the lookup can deal with hot ones.
    """
    seen = Observation()
    spread = (lines.observe(seen, F.count(F.lit(1)).alias("rows")).groupBy("h1", "h2")
              .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.count("*").alias("n"))
              .withColumn("likely", F.col("sites") >= min_sites * (1 - margin)))
    listed = staged(spread.where(F.col("likely") | (F.col("n") >= HEAVY)))
    sure = listed.select("h1", "h2", "likely", (F.col("sites") > min_sites * (1 + margin)).alias("sure"), "n")
    rows = 0 if listed.isEmpty() else seen.get["rows"]  # a plan without rows may be cut before it is observed
    found = staged(lookup(lines, sure, ["h1", "h2"], "n", rows, "inner").where("likely").drop("likely"))
    total = listed.where("likely").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lines_out = (found.groupBy("h1", "h2")
                 .agg(F.max("sure").alias("sure"), F.countDistinct(F.when(~F.col("sure"), F.col("site"))).alias("exact"),
                      F.min(F.struct("doc", "text_hash", "pos")).alias("first"), F.count("*").alias("n"))
                 .where(F.col("sure") | (F.col("exact") >= min_sites)).select("h1", "h2", "first", "n"))
    return found, lines_out, total


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source",
               min_sites: int = MIN_SITES, margin: float = MARGIN, lg_k: int = LG_K) -> DataFrame:
    """`docs` with boilerplate lines taken out of `text`, and the columns __n_lines and __n_removed.

    Lines are compared without blanks, tabs and carriage returns at their ends; blank lines are never removed. The first
    occurrence (least id, a null id before all others, then place in the text) stays. A null text has no lines and stays null; a text that loses all
    its lines becomes empty and its row stays. A null site counts for no site. Repeated rows are treated alike.
    """
    lines = _lines(docs, doc_id, text, site)
    found, spread, total = boilerplate(lines, min_sites, margin, lg_k)
    here = F.struct("doc", "text_hash", "pos")
    drops = (lookup(found.drop("sure", "site"), spread, ["h1", "h2"], "n", total, "inner").where(here != F.col("first"))
             .groupBy(F.col("doc").alias("__doc"), F.col("text_hash").alias("__text_hash"))
             .agg(F.collect_set("pos").alias("__drop")))
    doc, text_hash = row_key(doc_id, text)
    split = F.split(F.col(text), "\n")
    left = F.array_join(F.filter(split, lambda _, i: ~F.array_contains("__drop", i)), "\n")
    return (docs.withColumns({"__doc": doc, "__text_hash": text_hash})
            .join(drops, ["__doc", "__text_hash"], "left")
            .withColumns({"__n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("long"),
                          "__n_removed": F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long")})
            .withColumn(text, F.when(F.col("__drop").isNull(), F.col(text)).otherwise(left))
            .select(*quoted(docs.columns), "__n_lines", "__n_removed"))
