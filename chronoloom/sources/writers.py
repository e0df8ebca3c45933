"""Sinks: the deliverable, score tables, maps and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.records import to_summary


def write_summary(rows: DataFrame, path: str, kind: str = "parquet", extra: tuple[str, ...] = ()) -> None:
    """The fixed columns (and ``extra`` ones), one folder per report.

    Rows are dealt by report, so that each report is a file or few; AQE splits large ones.
    """
    fixed = to_summary(rows)
    out = rows.withColumns({c: F.col(c).cast(fixed.schema[c].dataType) if c in rows.columns else F.lit(None).cast(fixed.schema[c].dataType) for c in fixed.columns}).select(*fixed.columns, *extra)
    writer = out.hint("rebalance", "report_id").write.mode("overwrite").partitionBy("report_id")
    (writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path))


def write_table(rows: DataFrame, path: str, keys: list[str]) -> None:
    """A small result as one sorted CSV file with a header."""
    rows.orderBy(*keys).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_columns(rows: DataFrame, found: DataFrame, key: str, source: str, target: str) -> None:
    """A CSV with further columns, by key; where they are there already they are replaced. Never over what is being read."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("columns cannot be appended to the table that is being read")
    added = [c for c in found.columns if c != key]
    joined = rows.drop(*added).join(found, key, "left")
    joined.select(*[c for c in rows.columns if c not in added], *added).write.mode("overwrite").option("header", True).csv(target)


def write_patterns(patterns: DataFrame, path: str) -> None:
    patterns.orderBy("pattern_id").write.mode("overwrite").json(path)


def match_dump(linked: DataFrame) -> DataFrame:
    """Every find with what became of it: matched, MISSED, or an extra of some kind."""
    status = F.when(F.col("gold_id").isNull(), "EXTRA").when(F.col("output_id").isNull(), "MISSED").otherwise("matched")
    return linked.withColumn("status", status)


def with_fallback(primary: DataFrame, fallback: DataFrame, status: DataFrame, key: str = "report_id") -> DataFrame:
    """Rows of the reports whose primary path succeeded, and the fallback's rows of all others."""
    good = status.where("status = 'ok'").select(key)
    return primary.join(good, key, "left_semi").unionByName(fallback.join(good, key, "left_anti"), allowMissingColumns=True)


def run_log(statuses: DataFrame) -> DataFrame:
    """(status, n_reports, seconds) of a batch."""
    return statuses.groupBy("status").agg(F.count("*").alias("n_reports"), F.sum("seconds").alias("seconds"))
