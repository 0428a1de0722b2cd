"""Operator 3: line deduplication by overlapping three-line windows (DataFrame functions only).

Every run of ``width`` consecutive lines is hashed (128 bits).  Of the places
where a window occurs in the whole table, the first in order of document id,
text hash and position stays; at each later place the window's lines are
covered.  Overlapping and touching covered windows are merged into spans, and
the lines outside the spans are put together again.

A line that is covered has an earlier copy in the place that covers it, and so
on back to a place that nothing covers: no line vanishes from the table.

Only hashes and positions are grouped; hot windows are counted on the map
side and joined back with a plain equi-join, which adaptive execution can
split.  Texts are shuffled once, by document, to meet their spans.

Defined results: null text stays null; an empty text or one of fewer than
``width`` lines has no window and stays; windows of blank lines only are not
counted; rows with the same id and text are one occurrence and get the same
result; ids may be null (they come first); an empty table gives no rows;
extra columns are kept, but for one named as the count (``n_removed``), which
is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def windows(docs: DataFrame, width: int) -> DataFrame:
    """Window places: _id, _hash, _pos, _w1, _w2."""
    lines = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.split("text", "\n", -1).alias("_lines"))
    many = lines.filter(F.size("_lines") >= width)

    def one(i):
        own = [F.get("_lines", i + k) for k in range(width)]
        return F.struct(
            i.alias("pos"),
            F.xxhash64(*own).alias("w1"),
            F.xxhash64(*own[::-1], F.lit(width)).alias("w2"),
            F.forall(F.slice("_lines", i + 1, width), lambda x: F.trim(x) == "").alias("blank"),
        )

    at = F.sequence(F.lit(0), F.size("_lines") - width)
    return (
        many.select("_id", "_hash", F.explode(F.transform(at, one)).alias("w"))
        .filter(~F.col("w.blank"))
        .select("_id", "_hash", F.col("w.pos").alias("_pos"), F.col("w.w1").alias("_w1"), F.col("w.w2").alias("_w2"))
    )


def covered(docs: DataFrame, width: int) -> DataFrame:
    """For each document with covered lines: the kept gaps (from, to) before each span, and the last span's end."""
    place = windows(docs, width)
    here = F.struct("_id", "_hash", "_pos")
    repeated = (
        place.groupBy("_w1", "_w2").agg(F.count("*").alias("_n"), F.min(here).alias("_first")).filter(F.col("_n") > 1).drop("_n")
    )
    later = place.join(repeated, ["_w1", "_w2"]).filter(here > F.col("_first")).select("_id", "_hash", "_pos")
    before = F.lag("_pos").over(W.partitionBy("_id", "_hash").orderBy("_pos")) + width
    gap = F.when(before.isNull() | (F.col("_pos") > before), F.struct(F.coalesce(before, F.lit(0)).alias("a"), F.col("_pos").alias("b")))
    return (
        later.withColumn("_gap", gap)
        .groupBy("_id", "_hash")
        .agg(F.sort_array(F.collect_list("_gap")).alias("_gaps"), (F.max("_pos") + width).alias("_end"))
    )


def dedup_lines(docs: DataFrame, width: int = 3, count: str = "n_removed") -> DataFrame:
    """The documents with later window occurrences removed, and the number of lines removed as ``count``."""
    spans = covered(docs, width)
    own = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_doc_id"), F.xxhash64("text").alias("_doc_hash"))
    both = own.join(spans, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_doc_hash") == F.col("_hash")), "left")
    text = F.col("_doc.text")
    cut = both.withColumn("_lines", F.when(F.col("_end").isNotNull(), F.split(text, "\n", -1)))
    kept = F.concat(
        F.flatten(F.transform("_gaps", lambda g: F.slice("_lines", g["a"] + 1, g["b"] - g["a"]))),
        F.slice("_lines", F.col("_end") + 1, F.greatest(F.size("_lines") - F.col("_end"), F.lit(0))),
    )
    whole = F.col("_end").isNull()
    changed = cut.withColumn("_kept", kept)
    new_text = F.when(whole, text).otherwise(F.array_join("_kept", "\n")).alias("text")
    return changed.select(
        *[new_text if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns if c != count],
        F.when(whole, 0).otherwise(F.size("_lines") - F.size("_kept")).cast("long").alias(count),
    )
