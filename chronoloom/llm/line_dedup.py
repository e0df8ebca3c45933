"""Removal of repeated passages by overlapping three-line windows, DataFrame functions only.

Every three consecutive lines of a document form a window; its digest of 128 bits is taken
over the trimmed lines, so that even 10^12 different windows share one with a chance below
10^-14. A window that occurs again, in the same or in another document, is kept where it
stands first (smallest document id, then text digest, then position). All lines that a
later occurrence covers go. What is removed therefore always still stands somewhere: five
equal lines in a row keep the first.

Documents of fewer than three lines have no window and stay as they are, as do
windows of blank lines. Null texts stay null. Very long texts are split into lines within
their row; what is moved and sorted is a row of fixed size for each window. Rows with equal
ids and texts are one document: all keep or lose the same lines. Other columns pass
through, whatever they are called; ``n_removed`` replaces an input column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialise

LINES = 3


def _digest(*values: Column) -> Column:
    """Two 64-bit hashes with different seeds."""
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(7), *values).alias("b"))


def _windows(lines: str, size: int) -> Column:
    """An array with the digest of each window of a column of (digest, blank) lines, null for blank ones."""
    count = F.size(lines) - (size - 1)
    shifted = F.arrays_zip(*[F.slice(lines, k + 1, count).alias(f"l{k}") for k in range(size)])

    def window(part: Column) -> Column:
        held = [part[f"l{k}"] for k in range(size)]
        blank = held[0]["blank"]
        for line in held[1:]:
            blank = blank & line["blank"]
        return F.when(~blank, _digest(*[line["digest"][half] for line in held for half in "ab"]))

    return F.when(count > 0, F.transform(shifted, window))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = LINES) -> DataFrame:
    """Per document with repeated windows: doc_id, text_hash, and the covered line numbers from 0."""
    keyed = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), _digest(F.col(text)).alias("text_hash"), F.split(text, "\n", -1).alias("raw"))
    keyed = keyed.withColumn("trimmed", F.transform("raw", lambda x: F.trim(x))).drop("raw")
    # columns of their own: inside one expression the inner one would be computed for every line
    keyed = keyed.withColumn("lines", F.transform("trimmed", lambda x: F.struct(_digest(x).alias("digest"), (F.length(x) == 0).alias("blank")))).drop("trimmed")
    places = materialise(keyed.select("doc_id", "text_hash", F.posexplode(_windows("lines", size)).alias("at", "window")).where("window is not null"), "windows")
    place = F.struct("doc_id", "text_hash", "at")
    # one row per window that stands in two places; combined before the shuffle
    repeated = materialise(places.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                           .where("first < last").select("window", "first"), "repeats")
    # neither side is partitioned yet, so a window with many places is split at run time
    later = places.join(repeated, "window").where(place > F.col("first"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.col("at") + k)))))
    return later.groupBy("doc_id", "text_hash").agg(covered.alias("covered"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = LINES) -> DataFrame:
    """``docs`` with the later occurrences cut from ``text``, and n_removed, the number of lines cut."""
    covered = repeated_lines(docs, doc_id, text, size).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("covered"))
    # the caller's columns travel inside one, so that their names meet none of these
    rest = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("row"), F.col(f"`{doc_id}`").alias("own"), F.col(f"`{text}`").alias("text"))
    joined = packed.join(covered, F.col("own").eqNullSafe(F.col("id")) & (_digest(F.col("text")) == F.col("hash")), "left")
    # a column of its own: inside the function below it would be split again for every line
    joined = joined.withColumn("lines", F.when(F.col("covered").isNotNull(), F.split("text", "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    left = F.array_join(F.transform(kept, lambda i: F.element_at("lines", i + 1)), "\n")
    left = F.when(F.col("covered").isNull(), F.col("text")).otherwise(left)
    out = {c: left.alias(c) if c == text else F.col(f"row.c{rest.index(c)}").alias(c) for c in docs.columns}
    removed = F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed")
    return joined.select(*[removed if c == "n_removed" else v for c, v in out.items()], *([] if "n_removed" in out else [removed]))
