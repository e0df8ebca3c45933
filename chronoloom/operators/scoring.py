"""Verdicts, roll-ups and repeatability statistics over linked records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

FIELDS = ("site_name", "pottery", "typology", "start_date", "end_date")
VERDICTS = ("exact", "acceptable", "incorrect", "missing", "overclaim")
TOLERANCE = 25


def _blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def _both(gold: Column, found: Column, verdict: Column) -> Column:
    """``verdict`` where both have a value; agreed blanks are exact, one blank is incorrect."""
    return F.when(~_blank(gold) & ~_blank(found), verdict).when(_blank(gold) & _blank(found), "exact").otherwise("incorrect")


def site_verdict(gold: Column, found: Column) -> Column:
    parts = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    a, b = parts(gold), parts(found)
    nested = (F.size(a) > 0) & (F.size(b) > 0) & (tx.is_subset(a, b) | tx.is_subset(b, a))
    return _both(gold, found, F.when(F.lower(gold) == F.lower(found), "exact").when(nested, "acceptable").otherwise("incorrect"))


def pottery_verdict(gold: Column, found: Column, gold_tokens: Column, found_tokens: Column, gold_family: Column, found_family: Column, least: float = 0.34) -> Column:
    a, b = tx.only_alnum(gold), tx.only_alnum(found)
    close = (F.size(gold_tokens) > 0) & (F.size(found_tokens) > 0) & ((tx.jaccard(gold_tokens, found_tokens) >= least) | tx.is_subset(gold_tokens, found_tokens) | tx.is_subset(found_tokens, gold_tokens))
    family = F.coalesce((gold_family == found_family) & (gold_family != ""), F.lit(False))
    return _both(a, b, F.when(a == b, "exact").when(close | family, "acceptable").otherwise("incorrect"))


def typology_verdict(gold: Column, found: Column) -> Column:
    return _both(gold, found, F.when(gold == found, "exact").otherwise("incorrect"))


def endpoint_verdict(gold: Column, found: Column, strict: Column, tolerance: int = TOLERANCE) -> Column:
    """Within the tolerance is acceptable unless the gold record has a typology, which pins its date."""
    near = ~strict & (F.abs(gold - found) <= tolerance)
    return _both(gold, found, F.when(gold == found, "exact").when(near, "acceptable").otherwise("incorrect"))


def verdict_cells(linked: DataFrame, report: str = "report_id") -> DataFrame:
    """(report, field, verdict, gold, found): five cells of each pair or unpaired record.

    ``linked`` has the structs ``gold`` and ``output`` with site, pot, typ, toks, family, start, end.
    """
    g, p = F.col("gold"), F.col("output")
    strict = ~_blank(g["typ"])
    paired = {
        "site_name": (site_verdict(g["site"], p["site"]), "site"),
        "pottery": (pottery_verdict(g["pot"], p["pot"], g["toks"], p["toks"], g["family"], p["family"]), "pot"),
        "typology": (typology_verdict(g["typ"], p["typ"]), "typ"),
        "start_date": (endpoint_verdict(g["start"], p["start"], strict), "start"),
        "end_date": (endpoint_verdict(g["end"], p["end"], strict), "end"),
    }
    solo = F.when(p.isNull(), "missing").when(g.isNull(), "overclaim")
    cells = [F.struct(F.lit(f).alias("field"), F.coalesce(solo, v).alias("verdict"), g[c].cast("string").alias("gold"), p[c].cast("string").alias("found")) for f, (v, c) in paired.items()]
    return linked.select(report, F.inline(F.array(*cells)))


def verdict_group(verdict: Column) -> Column:
    return F.when(verdict.isin("exact", "acceptable"), "correct").otherwise(verdict)


def verdict_cube(cells: DataFrame, report: str = "report_id") -> DataFrame:
    """A row per report and a TOTAL row: a column for each field and verdict group, and totals."""
    counts = [F.count_if((F.col("field") == f) & (F.col("group") == v)).alias(f"{f}_{v}") for f in FIELDS for v in ("correct", "incorrect", "missing", "overclaim")]
    totals = [F.count_if(F.col("group") == v).alias(f"total_{v}") for v in ("correct", "incorrect", "missing", "overclaim")]
    rolled = cells.withColumn("group", verdict_group(F.col("verdict"))).rollup(report).agg(*counts, *totals, F.count("*").alias("total_values"), F.grouping(report).alias("_g"))
    return rolled.withColumn(report, F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col(report).cast("string"))).drop("_g")


def detection_totals(linked: DataFrame, report: str = "report_id") -> DataFrame:
    """A row per report and a TOTAL row: gold records, matched, missed and extra ones, recall, and matched pairs that agree.

    ``linked`` as in ``verdict_cells``. Recall without gold records is 1. Names agree if they are
    equal, similar or of one family; other fields if they are equal or both missing; ranges if
    they meet, an undated gold record with anything.
    """
    g, p = F.col("gold"), F.col("output")
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    name = (tx.only_alnum(g["pot"]) != "") & pottery_verdict(g["pot"], p["pot"], g["toks"], p["toks"], g["family"], p["family"]).isin("exact", "acceptable")
    family = F.coalesce((g["family"] == p["family"]) & (g["family"] != ""), F.lit(False))
    low, high = F.lit(-9999), F.lit(9999)
    meets = (F.coalesce(p["start"], low) <= F.coalesce(g["end"], high)) & (F.coalesce(g["start"], low) <= F.coalesce(p["end"], high))
    undated = lambda x: x["start"].isNull() & x["end"].isNull()
    agree = {
        "site": text(g["site"]) == text(p["site"]), "pottery": F.coalesce(name, F.lit(False)) | family, "typology": F.coalesce(g["typ"], F.lit("")) == F.coalesce(p["typ"], F.lit("")),
        "start": g["start"].eqNullSafe(p["start"]), "end": g["end"].eqNullSafe(p["end"]), "overlap": undated(g) | (~undated(p) & meets),
    }
    both = g.isNotNull() & p.isNotNull()
    counts = {"n_gold": g.isNotNull(), "n_matched": both, "n_missed": p.isNull(), "n_extra": g.isNull()} | {f"n_{k}": both & v for k, v in agree.items()}
    rolled = linked.rollup(report).agg(*[F.count_if(c).alias(k) for k, c in counts.items()], F.grouping(report).alias("_g"))
    recall = F.coalesce(F.try_divide("n_matched", "n_gold"), F.lit(1.0))
    return rolled.withColumns({report: F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col(report).cast("string")), "recall": recall}).drop("_g")


def accuracy_cube(cells: DataFrame, dimensions: list[str]) -> DataFrame:
    """Values, accepted values and their share for every subset of the dimensions; null means all."""
    accepted = F.count_if(F.col("verdict").isin("exact", "acceptable"))
    return cells.cube(*dimensions).agg(F.count("*").alias("n_values"), accepted.alias("n_accepted"), F.grouping_id().cast("int").alias("grouping_id")).withColumn("share", F.try_divide("n_accepted", "n_values"))


def extras_triage(extras: DataFrame, families: DataFrame, report: str = "report_id") -> DataFrame:
    """Unmatched output rows as typed, undated, recap (its family is already counted) or dated."""
    known = families.select(report, "family").where("family <> ''").distinct().withColumn("_known", F.lit(True))
    undated = F.col("start").isNull() & F.col("end").isNull()
    kind = F.when(~_blank(F.col("typ")), "typed").when(undated, "undated").when(F.coalesce("_known", F.lit(False)), "recap").otherwise("dated")
    return extras.join(known, [report, "family"], "left").withColumn("category", kind).drop("_known")


def variance(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 where all are equal), range and coefficient of variation."""
    out = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    sd = F.when(F.col("low") == F.col("high"), 0.0).otherwise(F.col("sd"))
    return out.withColumn("sd", sd).withColumn("range", F.col("high") - F.col("low")).withColumn("cv", F.try_divide("sd", "mean"))


def pooled_runs(rows: DataFrame, keys: list[str], run: str = "run") -> DataFrame:
    """Each distinct discrepancy with the runs that show it."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(run)).alias("_runs")).withColumns({"n_runs": F.size("_runs"), "runs_present": F.array_join(F.col("_runs").cast("array<string>"), ";")}).drop("_runs")


def quartiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q")).select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def adjudicated(missing: DataFrame, overclaim: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, n_pairs): missing and overclaimed records that adjudication pairs up, k-th with k-th."""
    rank = lambda df: df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rank(missing).join(rank(overclaim).select(*keys, "_k"), [*keys, "_k"]).groupBy(*keys).agg(F.count("*").alias("n_pairs"))


def rescored(correct: Column, total: Column, pairs: Column, now_correct: Column, fields: int = 5) -> Column:
    """The share of correct values once ``pairs`` records count once instead of twice."""
    return F.try_divide(correct + now_correct, total - fields * pairs)
