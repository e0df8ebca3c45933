"""Weighted intervals: aoristic weights, binned curves, Monte Carlo bands, profile agreement.

Records are (site_id, start, end) with ``end > start``; others are dropped by ``dated``.
Periods and bins are tiny literal arrays inside the expressions: nothing is broadcast or
cross joined, each record is expanded only into the bins that it overlaps, and weights are
combined before the one shuffle on (site, period) or (bin).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise


class Period(NamedTuple):
    label: str
    start: int
    end: int


#: The three periods, and the bins' first edge, width and number.
PERIODS = (Period("early", -12, 70), Period("middle", 71, 275), Period("late", 276, 450))
FIRST_EDGE, BIN_YEARS, BINS = -12, 25, 19
PHASE_SHARE, ACTIVE_WEIGHT = 0.10, 0.05


def dated(records: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Both ends as numbers, and a positive duration."""
    out = records.withColumn(start, F.col(start).cast("double")).withColumn(end, F.col(end).cast("double"))
    return out.where(F.col(end) > F.col(start))


def shared_years(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def period_weight(period: Period, start: str = "start", end: str = "end") -> Column:
    s, e = F.col(start), F.col(end)
    return shared_years(s, e, F.lit(float(period.start)), F.lit(float(period.end))) / (e - s)


def site_weights(records: DataFrame, periods: tuple[Period, ...] = PERIODS, site: str = "site_id") -> DataFrame:
    """One row per site with the summed weight of each period."""
    return dated(records).groupBy(site).agg(*[F.sum(period_weight(p)).alias(f"w_{p.label}") for p in periods])


def intensities(weights: DataFrame, periods: tuple[Period, ...] = PERIODS) -> DataFrame:
    """Weight per year of each period."""
    return weights.withColumns({f"i_{p.label}": F.col(f"w_{p.label}") / (p.end - p.start) for p in periods})


def shares(weights: DataFrame, periods: tuple[Period, ...] = PERIODS) -> DataFrame:
    """Each site's weights over their sum; null where the sum is 0."""
    total = sum((F.col(f"w_{p.label}") for p in periods[1:]), F.col(f"w_{periods[0].label}"))
    return weights.withColumns({f"p_{p.label}": F.try_divide(F.col(f"w_{p.label}"), total) for p in periods})


def long_form(weights: DataFrame, prefix: str, value: str, periods: tuple[Period, ...] = PERIODS, site: str = "site_id") -> DataFrame:
    """(site, period, value) rows from one column per period."""
    return weights.select(site, F.inline(F.array(*[F.struct(F.lit(p.label).alias("period"), F.col(prefix + p.label).alias(value)) for p in periods])))


def binned(records: DataFrame) -> DataFrame:
    """Each record once per bin that it overlaps: bin, bin_start and weight are added."""
    s, e = F.col("start"), F.col("end")
    low = F.greatest(F.lit(0), F.floor((s - FIRST_EDGE) / BIN_YEARS)).cast("int")
    high = F.least(F.lit(BINS - 1), F.ceil((e - FIRST_EDGE) / BIN_YEARS) - 1).cast("int")
    out = dated(records).withColumn("bin", F.explode(F.when(low <= high, F.sequence(low, high))))
    edge = F.lit(float(FIRST_EDGE)) + F.col("bin") * BIN_YEARS
    return out.withColumn("bin_start", edge.cast("int")).withColumn("weight", shared_years(s, e, edge, edge + BIN_YEARS) / (e - s))


def regional_curve(records: DataFrame) -> DataFrame:
    return binned(records).groupBy("bin", "bin_start").agg(F.sum("weight").alias("weight"))


def active_sites(records: DataFrame, site: str = "site_id") -> DataFrame:
    """Sites with more than a trace of weight, per bin."""
    per_site = binned(records).groupBy("bin", "bin_start", site).agg(F.sum("weight").alias("w"))
    return per_site.groupBy("bin", "bin_start").agg(F.count_if(F.col("w") > ACTIVE_WEIGHT).alias("n_active"))


def site_spans(records: DataFrame, site: str = "site_id") -> DataFrame:
    return dated(records).groupBy(site).agg(F.min("start").alias("first_year"), F.max("end").alias("last_year"), F.count("*").alias("n_records"))


def monte_carlo_moments(records: DataFrame, periods: tuple[Period, ...] = PERIODS, site: str = "site_id") -> DataFrame:
    """Exact mean and standard deviation of the simulated counts, and the number of phases.

    A record falls into a period with probability equal to its weight, independently of the
    others, so a count has mean sum(p) and variance sum(p(1-p)); no draw is needed.
    """
    sums = [F.sum(period_weight(p)).alias(f"mean_{p.label}") for p in periods]
    sums += [F.sqrt(F.sum(period_weight(p) * (1 - period_weight(p)))).alias(f"sd_{p.label}") for p in periods]
    out = dated(records).groupBy(site).agg(*sums)
    total = sum((F.col(f"mean_{p.label}") for p in periods), F.lit(0.0))
    phases = sum((F.when((total > 0) & (F.col(f"mean_{p.label}") > PHASE_SHARE * total), 1).otherwise(0) for p in periods), F.lit(0))
    return out.withColumn("n_phases", phases.cast("int"))


def simulated_counts(records: DataFrame, sims: int, seed: int = 42) -> DataFrame:
    """(sim, bin, n): dated records drawn uniformly inside their ranges, per bin of each simulation.

    Records with equal ranges are counted first; how many of them fall into each bin is one
    multinomial draw per simulation, seeded by the range. So the work grows with the number of
    different ranges, not of records, and results do not depend on the partitioning.
    """
    spark = records.sparkSession
    ranges = dated(records).groupBy(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")).agg(F.count("*").alias("n"))
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "start", "end")  # few rows, each with many draws
    edges = FIRST_EDGE + BIN_YEARS * np.arange(BINS + 1)

    def draw(batches):
        total = np.zeros((sims, BINS), np.int64)
        for batch in batches:
            for start, end, n in zip(*(batch[c].to_pylist() for c in ("start", "end", "n"))):
                share = np.clip(np.minimum(end, edges[1:]) - np.maximum(start, edges[:-1]), 0, None) / (end - start)
                inside = np.flatnonzero(share)
                # the last of the outcomes is a year outside all bins
                chances = np.append(share[inside], max(0.0, 1 - share[inside].sum()))
                generator = np.random.default_rng([seed, *np.array([start, end]).view(np.uint32).tolist()])
                total[:, inside] += generator.multinomial(n, chances / chances.sum(), size=sims)[:, :-1]
        sim, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(sim.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[sim, at])], ["sim", "bin", "n"])

    return ranges.mapInArrow(draw, "sim int, bin int, n long").groupBy("sim", "bin").agg(F.sum("n").alias("n"))


def monte_carlo_band(records: DataFrame, sims: int, seed: int = 42) -> DataFrame:
    """Mean, population deviation and 5 to 95 percentile band of the simulated counts per bin."""
    counts = simulated_counts(records, sims, seed)
    # simulations without a draw in a bin count zero there: sims x bins rows, both fixed
    grid = records.sparkSession.range(sims).select(F.col("id").cast("int").alias("sim"), F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    full = grid.join(counts, ["sim", "bin"], "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    band = F.percentile("n", F.array(F.lit(0.05), F.lit(0.95)))
    return full.groupBy("bin").agg(F.avg("n").alias("mc_mean"), F.stddev_pop("n").alias("mc_sd"), band.alias("band")).select("bin", "mc_mean", "mc_sd", F.col("band")[0].alias("p5"), F.col("band")[1].alias("p95"))


def average_ranks(rows: DataFrame, value: str, out: str, slices: int = 4096) -> DataFrame:
    """``rows`` with the average rank of a number between 0 and 1, without sorting all rows in one task.

    Equal values are counted first. Different values are ranked within slices of the range, and
    the rows of all slices below are added: ``slices`` + 1 sums that a window and a broadcast hold.
    ``rows`` meet their ranks by their values and are read twice, so they have to be written before:
    a sum of fractions differs in its last digits when its parts arrive in another order.
    """
    counts = rows.groupBy(value).agg(F.count("*").alias("_n")).withColumn("_slice", F.floor(F.col(value) * slices))
    sums = counts.groupBy("_slice").agg(F.sum("_n").alias("_m"))
    before = sums.select("_slice", (F.sum("_m").over(Window.orderBy("_slice")) - F.col("_m")).alias("_before"))
    upto = F.sum("_n").over(Window.partitionBy("_slice").orderBy(value))
    ranks = counts.withColumn("_upto", upto).join(F.broadcast(before), "_slice")
    # the mean of the places that equal values take
    rank = F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2.0
    return rows.join(ranks.select(F.col(value).alias("_v"), rank.alias(out)), F.col(value) == F.col("_v")).drop("_v")


def profile_agreement(one: DataFrame, two: DataFrame, periods: tuple[Period, ...] = PERIODS, site: str = "site_id") -> DataFrame:
    """Pearson, Spearman (average ranks), dominant-period agreement and mean absolute difference.

    Over the proportions of the sites that both sets have; one row.
    """
    a, b = long_form(shares(site_weights(one, periods, site), periods), "p_", "x", periods, site), long_form(shares(site_weights(two, periods, site), periods), "p_", "y", periods, site)
    # written once: the sums of a second reading need not be the same numbers
    both = materialise(a.join(b, [site, "period"]).where("x is not null and y is not null"), "profiles")
    order = {p.label: i for i, p in enumerate(periods)}
    place = F.create_map(*[F.lit(v) for pair in order.items() for v in pair])[F.col("period")]
    top = lambda v: F.max_by("period", F.struct(F.col(v), -place))  # noqa: E731  the first of equals
    dominant = both.groupBy(site).agg((top("x") == top("y")).cast("double").alias("same")).agg(F.avg("same").alias("dominant_agreement"), F.count("*").alias("n_sites"))
    ranked = average_ranks(average_ranks(both, "x", "rx"), "y", "ry")
    d2, n = F.sum((F.col("rx") - F.col("ry")) ** 2), F.count("*")
    stats = ranked.agg(F.corr("x", "y").alias("pearson"), (1 - 6 * d2 / (n * (n * n - 1))).alias("spearman"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_abs_diff"))
    return stats.join(F.broadcast(dominant))


def mapped_records(records: DataFrame, sites: DataFrame, key: str = "report_id", listed: str = "literature_id") -> DataFrame:
    """Records with the site whose ``;``-separated list names their report; of several the largest site id."""
    pairs = sites.select("site_id", F.explode(F.split(listed, ";")).alias("k")).select("site_id", F.trim("k").alias(key)).where(f"{key} <> ''")
    return records.join(pairs.groupBy(key).agg(F.max("site_id").alias("site_id")), key)
