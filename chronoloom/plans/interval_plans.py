"""Queries over dated intervals: orders as finds, nations as sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals as iv
from .catalogue import Tables, query

PERIOD_SQL = "(VALUES ('early', -12, 70), ('middle', 71, 275), ('late', 276, 450)) AS p(period, ps, pe)"
REC = """rec AS (SELECT o_orderkey AS id, c_nationkey AS site_id, (o_orderkey * 37 % 500 - 52)::DOUBLE AS s, (o_orderkey * 37 % 500 - 51 + o_custkey % 200)::DOUBLE AS e
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
LINES = """lin AS (SELECT s_nationkey AS site_id, (l_orderkey * 53 % 480 - 40)::DOUBLE AS s, (l_orderkey * 53 % 480 - 39 + l_partkey % 150)::DOUBLE AS e
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
W = """w AS (SELECT site_id, period, ps, pe, sum(greatest(0, least(e, pe) - greatest(s, ps)) / (e - s)) AS w FROM rec, """ + PERIOD_SQL + """ GROUP BY ALL)"""
BINS = "bins AS (SELECT i AS bin, -12 + 25 * i AS b FROM range(19) r(i))"


def finds(t: Tables) -> DataFrame:
    start = (F.col("o_orderkey") * 37) % 500 - 52
    joined = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("site_id"), start.alias("start"), (start + 1 + F.col("o_custkey") % 200).alias("end"))


def line_finds(t: Tables) -> DataFrame:
    start = (F.col("l_orderkey") * 53) % 480 - 40
    joined = t.lineitem.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("s_nationkey").alias("site_id"), start.alias("start"), (start + 1 + F.col("l_partkey") % 150).alias("end"))


def _wide(column: str) -> str:
    return ", ".join(f"sum(CASE WHEN period = '{p}' THEN {column} END) AS {{0}}_{p}" for p in ("early", "middle", "late"))


@query(f"WITH {REC}, {W} SELECT site_id, {_wide('w').format('w')} FROM w GROUP BY site_id")
def aoristic_weights(t: Tables) -> DataFrame:
    return iv.site_weights(finds(t))


@query(f"WITH {REC}, {W} SELECT site_id, n_name AS site_name, {_wide('w').format('w')}, {_wide('w / (pe - ps)').format('i')} FROM w JOIN nation ON site_id = n_nationkey GROUP BY ALL")
def aoristic_intensity(t: Tables) -> DataFrame:
    names = t.nation.select(F.col("n_nationkey").alias("site_id"), F.col("n_name").alias("site_name"))
    return iv.intensities(iv.site_weights(finds(t))).join(names, "site_id", "left")


@query(f"WITH {REC}, {W}, n AS (SELECT site_id, period, w / sum(w) OVER (PARTITION BY site_id) AS share FROM w) SELECT site_id, {_wide('share').format('p')} FROM n GROUP BY site_id")
def aoristic_normalized(t: Tables) -> DataFrame:
    return iv.shares(iv.site_weights(finds(t))).select("site_id", "p_early", "p_middle", "p_late")


@query(f"WITH {REC}, {BINS} SELECT bin, b AS bin_start, sum(greatest(0, least(e, b + 25) - greatest(s, b)) / (e - s)) AS weight FROM rec, bins WHERE s < b + 25 AND e > b GROUP BY ALL")
def regional_curve(t: Tables) -> DataFrame:
    return iv.regional_curve(finds(t))


@query(f"""WITH {REC}, {BINS}, x AS (SELECT bin, b, site_id, sum(greatest(0, least(e, b + 25) - greatest(s, b)) / (e - s)) AS w FROM rec, bins WHERE s < b + 25 AND e > b GROUP BY ALL)
SELECT bin, b AS bin_start, count(*) FILTER (w > 0.05) AS n_active FROM x GROUP BY ALL""")
def active_sites_per_bin(t: Tables) -> DataFrame:
    return iv.active_sites(finds(t))


@query(f"WITH {REC} SELECT site_id, min(s) AS first_year, max(e) AS last_year, count(*) AS n_records FROM rec GROUP BY site_id")
def site_spans(t: Tables) -> DataFrame:
    return iv.site_spans(finds(t))


@query(f"""WITH {REC}, x AS (SELECT site_id, period, greatest(0, least(e, pe) - greatest(s, ps)) / (e - s) AS p FROM rec, {PERIOD_SQL}),
m AS (SELECT site_id, period, sum(p) AS mean, sqrt(sum(p * (1 - p))) AS sd FROM x GROUP BY ALL), t AS (SELECT site_id, sum(mean) AS total FROM m GROUP BY site_id)
SELECT site_id, {_wide('mean').format('mean')}, {_wide('sd').format('sd')}, count(*) FILTER (total > 0 AND mean > 0.1 * total)::INT AS n_phases FROM m JOIN t USING (site_id) GROUP BY site_id""")
def mc_moments_analytic(t: Tables) -> DataFrame:
    return iv.monte_carlo_moments(finds(t))


@query()
def mc_sampled_band(t: Tables) -> DataFrame:
    return iv.monte_carlo_band(finds(t), sims=1000)


@query(f"""WITH {REC}, {LINES},
a AS (SELECT site_id, period, sum(greatest(0, least(e, pe) - greatest(s, ps)) / (e - s)) AS w FROM rec, {PERIOD_SQL} GROUP BY ALL),
b AS (SELECT site_id, period, sum(greatest(0, least(e, pe) - greatest(s, ps)) / (e - s)) AS w FROM lin, {PERIOD_SQL} GROUP BY ALL),
j AS (SELECT a.site_id, a.period, a.w / sum(a.w) OVER (PARTITION BY a.site_id) AS x, b.w / sum(b.w) OVER (PARTITION BY a.site_id) AS y FROM a JOIN b USING (site_id, period)),
r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM j),
o AS (SELECT site_id, first(period ORDER BY x DESC) = first(period ORDER BY y DESC) AS same FROM j GROUP BY site_id)
SELECT corr(x, y) AS pearson, 1 - 6 * sum((rx - ry) ** 2) / (count(*) * (count(*) ** 2 - 1)) AS spearman, avg(abs(x - y)) AS mean_abs_diff,
  (SELECT avg(same::INT) FROM o) AS dominant_agreement, (SELECT count(*) FROM o) AS n_sites FROM r""")
def profile_agreement(t: Tables) -> DataFrame:
    return iv.profile_agreement(finds(t), line_finds(t))


@query("""WITH lit AS (SELECT s_suppkey AS site_id, unnest(string_split(concat(s_suppkey, ';', s_suppkey * 3, ';', s_suppkey * 7), ';'))::BIGINT AS k FROM supplier),
m AS (SELECT k, max(site_id) AS site_id FROM lit GROUP BY k)
SELECT site_id, count(*) AS n_records, sum(o_totalprice) AS total FROM orders JOIN m ON o_custkey = k GROUP BY site_id""")
def report_site_map(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    sites = t.supplier.select(key.alias("site_id"), F.concat_ws(";", key, key * 3, key * 7).alias("literature_id"))
    mapped = iv.mapped_records(t.orders.select(F.col("o_custkey").cast("string").alias("report_id"), "o_totalprice"), sites)
    return mapped.groupBy("site_id").agg(F.count("*").alias("n_records"), F.sum("o_totalprice").alias("total"))
