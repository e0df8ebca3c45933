"""Queries over dates, records, linkage and scores: generated from orders, lineitem, part and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cues
from ..functions import dates as dt
from ..functions import text as tx
from ..operators import matching as mt
from ..operators import records as rc
from ..operators import scoring as sg
from .catalogue import Tables, query

PARTS = ("early", "mid", "late")


def centuries(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    part = F.element_at(F.array(*map(F.lit, PARTS), F.lit(None)), (key % 4 + 1).cast("int"))
    return t.orders.select("o_orderkey", (key % 7 + 1).alias("n"), part.alias("part"), (F.col("o_custkey") % 3 == 0).alias("before"))


CENTURY_SQL = """g AS (SELECT o_orderkey, o_orderkey % 7 + 1 AS n, [ 'early', 'mid', 'late', NULL ][o_orderkey % 4 + 1] AS part, o_custkey % 3 = 0 AS before FROM orders),
r AS (SELECT *, CASE WHEN before THEN -n * 100 ELSE (n - 1) * 100 + 1 END AS s, CASE WHEN before THEN -(n - 1) * 100 - 1 ELSE n * 100 END AS e FROM g),
c AS (SELECT *, (CASE WHEN part = 'late' THEN s + 50 WHEN part = 'mid' AND NOT before THEN s + 25 ELSE s END)::INT AS start_year,
  (CASE WHEN part = 'early' THEN s + 50 WHEN part = 'mid' AND NOT before THEN e - 25 ELSE e END)::INT AS end_year FROM r)"""


@query(f"WITH {CENTURY_SQL} SELECT o_orderkey, start_year, end_year FROM c")
def century_to_range(t: Tables) -> DataFrame:
    r = dt.century_range(F.col("n"), F.col("part"), F.col("before"))
    return centuries(t).select("o_orderkey", r["start"].alias("start_year"), r["end"].alias("end_year"))


@query(f"""WITH {CENTURY_SQL} SELECT o_orderkey, 1 AS n_signals, start_year, end_year, 'century_expression' AS date_type, 'medium' AS precision FROM c""")
def date_signals(t: Tables) -> DataFrame:
    """Sentences such as ``found with sherds of the late 3rd century BC`` through the parser."""
    ordinal = F.element_at(F.array(*map(F.lit, dt.ORDINALS_EN)), F.col("n").cast("int"))
    era = F.when(F.col("before"), " BC").otherwise(" AD")
    text = F.concat(F.lit("found with sherds of the "), F.coalesce(F.concat("part", F.lit(" ")), F.lit("")), ordinal, F.lit(" century"), era, F.lit(" there"))
    out = centuries(t).select("o_orderkey", dt.date_signals(text).alias("s"))
    first = F.get("s", 0)
    return out.select("o_orderkey", F.size("s").alias("n_signals"), first["start"].alias("start_year"), first["end"].alias("end_year"), first["date_type"].alias("date_type"), first["precision"].alias("precision"))


@query("""SELECT o_orderkey, (CASE WHEN o_custkey % 2 = 0 THEN -1 ELSE 1 END * (o_orderkey % 500 + 1))::INT AS year,
  CASE WHEN o_custkey % 2 = 0 THEN (o_orderkey % 500 + 1) || ' BC' ELSE 'AD ' || (o_orderkey % 500 + 1) END AS label FROM orders""")
def year_parse(t: Tables) -> DataFrame:
    text = F.concat(F.lit("ca. "), F.col("o_orderkey") % 500 + 1, F.when(F.col("o_custkey") % 2 == 0, " v. Chr.").otherwise(" AD"))
    year = dt.parse_year(text)
    return t.orders.select("o_orderkey", year.alias("year"), dt.format_year(year).alias("label"))


def evidence(t: Tables) -> DataFrame:
    """A vocabulary date and up to two text signals per order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = k * 37 % 400
    signal = lambda start, width, precision: F.struct(F.lit("x").alias("expression"), start.cast("int").alias("start"), (start + width).cast("int").alias("end"), F.lit("t").alias("date_type"), precision.alias("precision"))
    level = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (c % 3 + 1).cast("int"))
    second = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (k % 3 + 1).cast("int"))
    signals = F.slice(F.array(signal(s + c % 90 - 30, 40, level), signal(s + c % 60, 80, second)), 1, (k % 4 % 3).cast("int"))
    return t.orders.select("o_orderkey", F.when(k % 5 != 0, s).alias("vs"), F.when(k % 5 != 0, s + 100).alias("ve"), signals.alias("signals"), ((c % 10) / 10.0).alias("conf"))


EVIDENCE_SQL = """e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 37 % 400 END AS vs, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 37 % 400 + 100 END AS ve, o_custkey % 10 / 10.0 AS conf,
  o_orderkey * 37 % 400 + o_custkey % 90 - 30 AS s1, o_orderkey * 37 % 400 + o_custkey % 90 + 10 AS e1, o_custkey % 3 AS p1, o_orderkey * 37 % 400 + o_custkey % 60 AS s2, o_orderkey * 37 % 400 + o_custkey % 60 + 80 AS e2, o_orderkey % 3 AS p2, o_orderkey % 4 % 3 AS n FROM orders),
f AS (SELECT *, n > 0 AND p1 < 2 AS f1, n > 1 AND p2 < 2 AS f2 FROM e),
g AS (SELECT *, CASE WHEN n = 0 THEN NULL WHEN f1 AND f2 THEN least(s1, s2) WHEN f1 THEN s1 WHEN f2 THEN s2 WHEN n = 2 THEN least(s1, s2) ELSE s1 END AS lo,
  CASE WHEN n = 0 THEN NULL WHEN f1 AND f2 THEN greatest(e1, e2) WHEN f1 THEN e1 WHEN f2 THEN e2 WHEN n = 2 THEN greatest(e1, e2) ELSE e1 END AS hi,
  CASE WHEN n = 0 THEN 9 WHEN n = 1 THEN p1 ELSE least(p1, p2) END AS best, CASE WHEN n = 0 THEN 9 WHEN n = 1 THEN p1 ELSE greatest(p1, p2) END AS worst FROM f),
m AS (SELECT *, CASE WHEN vs IS NULL AND n = 0 THEN 'unassigned' WHEN n = 0 THEN 'typological_direct' WHEN vs IS NULL THEN 'text_only'
  WHEN NOT (vs <= hi AND lo <= ve) AND worst = 0 THEN 'text_overrides_typology' WHEN NOT (vs <= hi AND lo <= ve) THEN 'conflict_flagged'
  WHEN NOT f1 AND NOT f2 THEN 'typological_direct' WHEN lo >= vs AND hi <= ve AND (lo > vs OR hi < ve) THEN 'combined_narrowed' ELSE 'typological_direct' END AS method FROM g)"""


@query(f"""WITH {EVIDENCE_SQL} SELECT o_orderkey, method, (CASE WHEN method IN ('text_only', 'text_overrides_typology', 'combined_narrowed') THEN lo ELSE vs END)::INT AS start_year,
  (CASE WHEN method IN ('text_only', 'text_overrides_typology', 'combined_narrowed') THEN hi ELSE ve END)::INT AS end_year,
  (CASE method WHEN 'unassigned' THEN 0.0 WHEN 'text_only' THEN CASE best WHEN 0 THEN 0.85 WHEN 1 THEN 0.70 ELSE 0.55 END WHEN 'text_overrides_typology' THEN 0.70 WHEN 'conflict_flagged' THEN 0.30
    WHEN 'combined_narrowed' THEN least(conf, 0.95) ELSE least(conf, 0.9) END)::DOUBLE AS confidence FROM m""")
def reconcile_decision(t: Tables) -> DataFrame:
    d = dt.reconcile(F.col("vs"), F.col("ve"), F.col("signals"), F.col("conf"))
    return evidence(t).withColumn("d", d).select("o_orderkey", "d.method", F.col("d.start").alias("start_year"), F.col("d.end").alias("end_year"), "d.confidence")


@query("""SELECT o_orderkey, (CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 300 WHEN o_orderkey % 3 = 0 THEN o_custkey % 200 WHEN o_orderkey % 2 = 0 THEN 71 END)::INT AS start_year,
  CASE WHEN o_orderkey % 5 = 0 THEN 'typology' WHEN o_orderkey % 3 = 0 THEN 'text_explicit' WHEN o_orderkey % 2 = 0 THEN 'section_phase' END AS method FROM orders""")
def best_date_ladder(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rung = lambda on, start, width: dt.year_range(F.when(on, start), F.when(on, start + width))
    wide, slim = dt.year_range(F.col("o_custkey") % 200 - 10, F.col("o_custkey") % 200 + 90), dt.year_range(F.col("o_custkey") % 200, F.col("o_custkey") % 200 + 20)
    text = F.when(k % 3 == 0, dt.narrowest(F.array(wide, slim)))
    ladder = dt.best_date([("typology", rung(k % 5 == 0, k % 300, 50)), ("text_explicit", text), ("section_phase", rung(k % 2 == 0, F.lit(71), 204))])
    return t.orders.select("o_orderkey", ladder.alias("d")).select("o_orderkey", F.col("d.start").alias("start_year"), "d.method")


RANGE_SQL = "x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey * 37 % 900 - 200)::INT END AS s, CASE WHEN o_custkey % 4 <> 0 THEN (o_orderkey * 37 % 900 - 200 + o_custkey % 150)::INT END AS e FROM orders)"


def open_ranges(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = (k * 37 % 900 - 200).cast("int")
    return t.orders.select("o_orderkey", F.when(k % 4 != 0, s).alias("s"), F.when(c % 4 != 0, (s + c % 150).cast("int")).alias("e"))


@query(f"WITH {RANGE_SQL} SELECT * FROM x WHERE (s IS NULL AND e IS NULL) OR (coalesce(s, -1000000000) < 450 AND coalesce(e, 1000000000) > -52)")
def scope_filter(t: Tables) -> DataFrame:
    return open_ranges(t).where(dt.in_scope(F.col("s"), F.col("e")))


@query(f"WITH {RANGE_SQL} SELECT o_orderkey, CASE WHEN s IS NULL AND e >= -12 THEN -12 ELSE s END AS start_year, CASE WHEN e IS NULL AND s <= 450 THEN 450 ELSE e END AS end_year FROM x")
def clamp_ranges(t: Tables) -> DataFrame:
    c = dt.clamp_one_sided(F.col("s"), F.col("e"))
    return open_ranges(t).select("o_orderkey", c["start"].alias("start_year"), c["end"].alias("end_year"))


CUE_TEXTS = ("sherds were found here", "niet aangetroffen in de kuil", "similar to the bowl", "mogelijk een kom", "een bak", "since the excavation", "Willems (2007a), plate", "sherds gevonden (Willems 2007a)", "cf. Drag 37", "vergelijkbaar")
CUE_LABELS = ("present", "absent", "comparison", "uncertain", "uncertain", "irrelevant", "irrelevant", "present", "uncertain", "comparison")
CUE_LEVELS = (0.85, 0.90, 0.90, 0.70, 0.30, 0.85, 0.90, 0.85, 0.30, 0.90)


@query(f"""WITH x AS (SELECT o_orderkey, (o_orderkey % 10)::INT + 1 AS i, o_custkey % 20 AS n, o_custkey % 6 = 0 AS before, o_orderkey % 11 = 0 AS code FROM orders)
SELECT o_orderkey, CASE WHEN code THEN 'present' WHEN NOT before AND n >= 15 THEN 'irrelevant' WHEN before AND n >= 3 THEN 'irrelevant' ELSE {list(CUE_LABELS)}[i] END AS label,
  (CASE WHEN code THEN 0.95 WHEN NOT before AND n >= 15 THEN 0.95 WHEN before AND n >= 3 THEN 0.92 ELSE {list(CUE_LEVELS)}[i] END)::DOUBLE AS confidence FROM x""")
def context_classifier(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.element_at(F.array(*map(F.lit, CUE_TEXTS)), (k % 10 + 1).cast("int"))
    label = cues.classify_context(text, F.when(k % 11 == 0, "csv_pottery_1"), c % 20, c % 6 == 0)
    return t.orders.select("o_orderkey", label.alias("l")).select("o_orderkey", "l.label", "l.confidence")


def nested_records(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return rc.nested(t.orders.select(
        F.when(k % 50 != 0, F.concat(F.lit("record_"), k)).alias("record_id"), F.col("o_orderstatus").alias("report_id"), F.when(k % 9 != 0, "term").alias("term_canonical"),
        F.when(k % 7 != 0, "present").alias("context_label"), F.when(c % 12 != 0, c % 12 / 10.0).alias("context_confidence"), F.when(k % 3 != 0, k % 100).cast("int").alias("chrono_start"), F.when(k % 4 != 0, k % 90 + 5).cast("int").alias("chrono_end"),
        F.element_at(F.array(F.lit("assigned"), F.lit("skipped"), F.lit(None), F.lit("unassigned"), F.lit("")), (k % 5 + 1).cast("int")).alias("chrono_status"), F.when(c % 8 != 0, 0.5).alias("chrono_confidence"), F.when(k % 11 != 0, 1).alias("page"),
    ))


@query("""WITH x AS (SELECT o_orderkey AS k, o_orderstatus AS report_id, o_custkey AS c, o_orderkey % 5 IN (0, 4) AS ranged FROM orders),
i AS (SELECT report_id, (k % 50 = 0)::INT + (k % 9 = 0)::INT + (k % 7 = 0)::INT + (c % 12 = 0)::INT + (k % 5 IN (2, 4))::INT + (ranged AND (k % 3 = 0 OR k % 4 = 0))::INT + (ranged AND k % 3 = 0)::INT + (ranged AND k % 4 = 0)::INT
  + (c % 12 = 0 AND c % 8 = 0)::INT + (k % 11 = 0)::INT AS n FROM x)
SELECT report_id, count(*) AS total, count(*) FILTER (n = 0) AS valid, count(*) FILTER (n > 0) AS invalid, sum(n)::BIGINT AS n_issues FROM i GROUP BY report_id""")
def output_struct_validate(t: Tables) -> DataFrame:
    return rc.validation_summary(rc.validate(nested_records(t)))


# --- linkage and scores: parts are gold finds, a perturbed copy is the output


def gold(t: Tables) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return t.part.select((k % 10).alias("report_id"), k.alias("id"), F.concat(F.lit("Site "), k % 5).alias("site"), F.col("p_name").alias("pot"), F.when(k % 3 != 0, F.col("p_brand")).otherwise("").alias("typ"), tx.tokens(F.col("p_name")).alias("toks"), F.col("p_type").alias("family"), tx.only_alnum(F.col("p_name")).alias("key"), (s * 5).cast("int").alias("start"), F.when(k % 8 != 0, s * 5 + 60).cast("int").alias("end"))


def output(t: Tables) -> DataFrame:
    rows = t.part.where(F.col("p_partkey") % 11 != 0)
    k, s = F.col("p_partkey"), F.col("p_size")
    name = F.when(k % 4 == 0, F.regexp_extract("p_name", r"\w+$", 0)).otherwise(F.col("p_name"))
    return rows.select((k % 10).alias("report_id"), k.alias("id"), F.concat(F.lit("Site "), k % 5, F.when(k % 6 == 0, " North").otherwise("")).alias("site"), name.alias("pot"), F.when(k % 3 != 0, F.col("p_brand")).otherwise("").alias("typ"), tx.tokens(name).alias("toks"), F.col("p_type").alias("family"), tx.only_alnum(name).alias("key"), (s * 5 + k % 2 * 20).cast("int").alias("start"), F.when(k % 8 != 0, s * 5 + 60 + k % 3 * 15).cast("int").alias("end"))


LINK_SQL = """g AS (SELECT p_partkey % 10 AS report_id, p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE '' END AS typ, p_name, p_type, p_size FROM part),
gg AS (SELECT *, row_number() OVER (PARTITION BY report_id, typ, p_type ORDER BY id) AS k FROM g), pp AS (SELECT *, row_number() OVER (PARTITION BY report_id, typ, p_type ORDER BY id) AS k FROM g WHERE id % 11 <> 0),
j AS (SELECT coalesce(gg.report_id, pp.report_id) AS report_id, gg.id AS gi, pp.id AS pi, gg.typ, gg.p_name AS gn, CASE WHEN pp.id % 4 = 0 THEN regexp_extract(pp.p_name, '\\w+$') ELSE pp.p_name END AS pn,
  'Site ' || gg.id % 5 AS gsite, 'Site ' || pp.id % 5 || CASE WHEN pp.id % 6 = 0 THEN ' North' ELSE '' END AS psite, gg.p_size * 5 AS gs, CASE WHEN gg.id % 8 <> 0 THEN gg.p_size * 5 + 60 END AS ge,
  pp.p_size * 5 + pp.id % 2 * 20 AS ps, CASE WHEN pp.id % 8 <> 0 THEN pp.p_size * 5 + 60 + pp.id % 3 * 15 END AS pe
  FROM gg FULL JOIN pp ON gg.report_id = pp.report_id AND gg.typ = pp.typ AND gg.p_type = pp.p_type AND gg.k = pp.k)"""
CELL_SQL = LINK_SQL + """,
v AS (SELECT report_id, gi, pi, CASE WHEN pi IS NULL THEN 'missing' WHEN gi IS NULL THEN 'overclaim' END AS solo,
  CASE WHEN gsite = psite THEN 'exact' WHEN len(list_filter(string_split(lower(gsite), ' '), lambda x: NOT list_contains(string_split(lower(psite), ' '), x))) = 0 OR len(list_filter(string_split(lower(psite), ' '), lambda x: NOT list_contains(string_split(lower(gsite), ' '), x))) = 0 THEN 'acceptable' ELSE 'incorrect' END AS site_name,
  CASE WHEN regexp_replace(lower(gn), '[^a-z0-9]', '', 'g') = regexp_replace(lower(pn), '[^a-z0-9]', '', 'g') THEN 'exact' ELSE 'acceptable' END AS pottery, 'exact' AS typology,
  CASE WHEN gs = ps THEN 'exact' WHEN typ = '' AND abs(gs - ps) <= 25 THEN 'acceptable' ELSE 'incorrect' END AS start_date,
  CASE WHEN ge IS NULL AND pe IS NULL THEN 'exact' WHEN ge IS NULL OR pe IS NULL THEN 'incorrect' WHEN ge = pe THEN 'exact' WHEN typ = '' AND abs(ge - pe) <= 25 THEN 'acceptable' ELSE 'incorrect' END AS end_date FROM j),
c AS (SELECT report_id, field, coalesce(solo, verdict) AS verdict FROM (UNPIVOT v ON site_name, pottery, typology, start_date, end_date INTO NAME field VALUE verdict)),
q AS (SELECT report_id, field, verdict, CASE WHEN verdict IN ('exact', 'acceptable') THEN 'correct' ELSE verdict END AS grp FROM c)"""


def linked(t: Tables) -> DataFrame:
    """Pairs by rank within report, typology and family."""
    both = mt.link_by_rank(gold(t).withColumn("fam", F.col("family")).withColumn("ty", F.col("typ")), output(t).withColumn("fam", F.col("family")).withColumn("ty", F.col("typ")), ["report_id", "ty", "fam"], ["id"])
    return both


@query(f"WITH {LINK_SQL} SELECT report_id, gi AS gold_id, pi AS output_id FROM j")
def link_rankjoin(t: Tables) -> DataFrame:
    return linked(t).select("report_id", F.col("gold.id").alias("gold_id"), F.col("output.id").alias("output_id"))


@query(f"""WITH {LINK_SQL}, w AS (SELECT *, p.p_type AS gf, q.p_type AS pf FROM j LEFT JOIN part p ON p.p_partkey = gi LEFT JOIN part q ON q.p_partkey = pi),
y AS (SELECT report_id, gi, pi, gi IS NOT NULL AND pi IS NOT NULL AS b, lower(gsite) = lower(psite) AS sm, gf = pf AS pm, gs = ps AS st, ge IS NOT DISTINCT FROM pe AS en, ps <= coalesce(ge, 9999) AND gs <= coalesce(pe, 9999) AS ov FROM w)
SELECT coalesce(report_id::VARCHAR, 'TOTAL') AS report_id, count(gi) AS n_gold, count(*) FILTER (b) AS n_matched, count(*) FILTER (pi IS NULL) AS n_missed, count(*) FILTER (gi IS NULL) AS n_extra, count(*) FILTER (b AND sm) AS n_site,
  count(*) FILTER (b AND pm) AS n_pottery, count(*) FILTER (b) AS n_typology, count(*) FILTER (b AND st) AS n_start, count(*) FILTER (b AND en) AS n_end, count(*) FILTER (b AND ov) AS n_overlap, count(*) FILTER (b) / count(gi) AS recall FROM y GROUP BY ROLLUP (report_id)""")
def detection_totals(t: Tables) -> DataFrame:
    return sg.detection_totals(linked(t))


@query("""SELECT l_orderkey, l_linenumber, 'record_' || row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS record_id FROM lineitem""")
def record_numbers(t: Tables) -> DataFrame:
    return rc.with_record_ids(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "record_id")


@query()
def link_greedy(t: Tables) -> DataFrame:
    return mt.link_greedily(gold(t), output(t))


_CUBE = ", ".join(f"count(*) FILTER (field = '{f}' AND grp = '{v}') AS {f}_{v}" for f in sg.FIELDS for v in ("correct", "incorrect", "missing", "overclaim"))
_TOTAL = ", ".join(f"count(*) FILTER (grp = '{v}') AS total_{v}" for v in ("correct", "incorrect", "missing", "overclaim"))


@query(f"WITH {CELL_SQL} SELECT CASE WHEN grouping(report_id) = 1 THEN 'TOTAL' ELSE report_id::VARCHAR END AS report_id, {_CUBE}, {_TOTAL}, count(*) AS total_values FROM q GROUP BY ROLLUP (report_id)")
def verdict_cube(t: Tables) -> DataFrame:
    return sg.verdict_cube(sg.verdict_cells(linked(t)))


@query(f"WITH {CELL_SQL} SELECT report_id % 2 AS mode, field, count(*) AS n_values, count(*) FILTER (grp = 'correct') AS n_accepted, grouping(report_id % 2, field)::INT AS grouping_id, count(*) FILTER (grp = 'correct') / count(*) AS share FROM q GROUP BY CUBE (report_id % 2, field)")
def field_stats_cube(t: Tables) -> DataFrame:
    return sg.accuracy_cube(sg.verdict_cells(linked(t)).withColumn("mode", F.col("report_id") % 2), ["mode", "field"])


@query(f"""WITH {CELL_SQL}, a AS (SELECT report_id, count(*) FILTER (grp = 'correct') / count(*) AS share FROM q GROUP BY report_id)
SELECT report_id % 2 AS report_type, quantile_cont(share, 0.25) AS q1, quantile_cont(share, 0.5) AS median, quantile_cont(share, 0.75) AS q3 FROM a GROUP BY ALL""")
def median_by_type(t: Tables) -> DataFrame:
    share = F.avg(F.col("verdict").isin("exact", "acceptable").cast("double")).alias("share")
    per = sg.verdict_cells(linked(t)).groupBy("report_id").agg(share)
    return sg.quartiles(per.withColumn("report_type", F.col("report_id") % 2), ["report_type"], "share")


@query("""WITH x AS (SELECT p_partkey % 10 AS report_id, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE '' END AS typ, p_type AS family, p_partkey % 3 = 0 AS undated FROM part WHERE p_partkey % 2 = 1 OR p_partkey % 4 = 0),
f AS (SELECT DISTINCT p_partkey % 10 AS report_id, p_type AS family FROM part WHERE p_partkey % 6 = 2)
SELECT report_id, CASE WHEN typ <> '' THEN 'typed' WHEN undated THEN 'undated' WHEN f.family IS NOT NULL THEN 'recap' ELSE 'dated' END AS category, count(*) AS n FROM x LEFT JOIN f USING (report_id, family) GROUP BY ALL""")
def extras_triage(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = t.part.where((k % 2 == 1) | (k % 4 == 0)).select((k % 10).alias("report_id"), F.when(k % 4 == 0, F.col("p_brand")).otherwise("").alias("typ"), F.col("p_type").alias("family"), F.when(k % 3 != 0, 100).alias("start"), F.lit(None).cast("int").alias("end"))
    families = t.part.where(k % 6 == 2).select((k % 10).alias("report_id"), F.col("p_type").alias("family"))
    return sg.extras_triage(rows, families).groupBy("report_id", "category").agg(F.count("*").alias("n"))


def runs(t: Tables) -> DataFrame:
    return t.events.withColumn("run", F.dayofyear("ts") % 5 + 1)


@query("""WITH r AS (SELECT event_type, dayofyear(ts) % 5 + 1 AS run, avg(value) AS v FROM events GROUP BY ALL)
SELECT event_type, avg(v) AS mean, CASE WHEN min(v) = max(v) THEN 0 ELSE stddev_samp(v) END AS sd, min(v) AS low, max(v) AS high, count(v) AS n, max(v) - min(v) AS range, CASE WHEN min(v) = max(v) THEN 0 ELSE stddev_samp(v) END / avg(v) AS cv FROM r GROUP BY event_type""")
def variance_stats(t: Tables) -> DataFrame:
    return sg.variance(runs(t).groupBy("event_type", "run").agg(F.avg("value").alias("v")), ["event_type"], "v")


@query("""WITH r AS (SELECT DISTINCT user_id, event_type, dayofyear(ts) % 5 + 1 AS run FROM events)
SELECT user_id, event_type, count(*)::INT AS n_runs, string_agg(run::VARCHAR, ';' ORDER BY run) AS runs_present FROM r GROUP BY ALL""")
def pooled_runs(t: Tables) -> DataFrame:
    return sg.pooled_runs(runs(t), ["user_id", "event_type"])


@query("""WITH m AS (SELECT p_size, count(*) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL), o AS (SELECT p_size, count(*) AS n FROM part WHERE p_partkey % 5 = 1 GROUP BY ALL)
SELECT p_size, least(m.n, o.n) AS n_pairs, 100.0 / (400 - 5 * least(m.n, o.n)) AS share FROM m JOIN o USING (p_size)""")
def adjudicated_rescore(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    pairs = sg.adjudicated(t.part.where(k % 3 == 0), t.part.where(k % 5 == 1), ["p_size"], ["p_partkey"])
    return pairs.withColumn("share", sg.rescored(F.lit(90.0), F.lit(400), F.col("n_pairs"), F.lit(10.0)))


# --- suppression of repeats


@query("""WITH m AS (SELECT l_partkey % 100 AS ware, count(*) AS n FROM lineitem WHERE l_linenumber > 5 GROUP BY ALL), r AS (SELECT l_orderkey, l_linenumber, l_partkey % 100 AS ware, count(*) OVER (PARTITION BY l_partkey % 100) AS n,
  row_number() OVER (PARTITION BY l_partkey % 100 ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem WHERE l_linenumber <= 5)
SELECT l_orderkey, l_linenumber, r.ware FROM r LEFT JOIN m USING (ware) WHERE rn <= r.n - coalesce(m.n, 0)""")
def surplus_bagdiff(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("ware", F.col("l_partkey") % 100)
    out = mt.surplus(rows.where("l_linenumber <= 5"), rows.where("l_linenumber > 5"), ["ware"], ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "ware")


@query("""WITH u AS (SELECT CASE WHEN l_orderkey % 10 <> 0 THEN l_orderkey || '/' || l_partkey % 50 END AS regnum, l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 <> 0 THEN 't' END AS typology, CASE WHEN l_partkey % 4 <> 0 THEN 100 END AS start_date, l_quantity AS certainty,
  l_orderkey * 10 + l_linenumber AS position, (l_linenumber > 3)::INT AS src FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY regnum ORDER BY src, CASE WHEN src = 0 THEN typology IS NULL END, CASE WHEN src = 0 THEN start_date IS NULL END, CASE WHEN src = 0 THEN -certainty END, position) AS rn FROM u WHERE regnum IS NOT NULL)
SELECT regnum, l_orderkey, l_linenumber FROM n WHERE rn = 1 UNION ALL SELECT regnum, l_orderkey, l_linenumber FROM u WHERE regnum IS NULL""")
def regnum_upsert(t: Tables) -> DataFrame:
    k, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    rows = t.lineitem.select(F.when(k % 10 != 0, F.concat_ws("/", k, p % 50)).alias("regnum"), k, n, F.when(p % 3 != 0, "t").alias("typology"), F.when(p % 4 != 0, 100).alias("start_date"), F.lit(None).cast("int").alias("end_date"), F.col("l_quantity").alias("certainty"), (k * 10 + n).alias("position"))
    return rc.registration_union(rows.where("l_linenumber <= 3"), rows.where("l_linenumber > 3")).select("regnum", "l_orderkey", "l_linenumber")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity > 30 AS tab, l_discount > 0.05 AS mark, bool_or(l_quantity > 30) OVER (PARTITION BY l_orderkey, l_suppkey % 3) AS any_tab FROM lineitem)
SELECT l_orderkey, l_linenumber FROM x WHERE tab OR NOT any_tab OR NOT mark""")
def table_ref_dedup(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("canon", F.col("l_suppkey") % 3)
    return rc.table_references(rows, ["l_orderkey", "canon"], F.col("l_quantity") > 30, F.col("l_discount") > 0.05).select("l_orderkey", "l_linenumber")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'A' AS spec, bool_or(l_returnflag = 'A') OVER (PARTITION BY l_suppkey, l_partkey % 10) AS any_spec FROM lineitem) SELECT l_orderkey, l_linenumber FROM x WHERE spec OR NOT any_spec""")
def general_suppress(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("name", F.col("l_partkey") % 10)
    return mt.without_twins(rows, ["l_suppkey", "name"], F.col("l_returnflag") == "A").select("l_orderkey", "l_linenumber")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey * 10 AS pos, l_linenumber = 1 AS grp, l_quantity FROM lineitem),
y AS (SELECT *, count(*) FILTER (NOT grp) OVER (PARTITION BY l_suppkey ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 1500 FOLLOWING) AS n FROM x)
SELECT l_orderkey, l_linenumber FROM y WHERE NOT (grp AND l_quantity >= 2 AND n >= l_quantity)""")
def preview_suppress(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("pos", F.col("l_partkey") * 10)
    return rc.preview_groups(rows, ["l_suppkey"], "pos", F.col("l_linenumber") == 1, F.col("l_quantity")).select("l_orderkey", "l_linenumber")


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 20, l_returnflag ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) SELECT l_orderkey, l_linenumber FROM x WHERE n = 1""")
def cross_window_dedup(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumns({"pot": F.concat(F.lit("Pot "), F.col("l_partkey") % 20), "quote": F.concat(F.lit("Quote "), F.col("l_returnflag"))})
    return rc.across_windows(rows, "l_suppkey", "pot", "quote", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 5 AS owner FROM lineitem), b AS (SELECT owner, 'block ' || string_agg(DISTINCT 'q' || (l_orderkey % 7) || ';', '') AS t, l_orderkey FROM x GROUP BY l_orderkey, owner),
o AS (SELECT l_orderkey, count(DISTINCT owner) AS n, max(owner) AS owner FROM x GROUP BY l_orderkey) SELECT l_orderkey AS quote_id, owner FROM o WHERE n = 1""")
def unique_owner(t: Tables) -> DataFrame:
    key = F.col("l_orderkey")
    text = F.concat(F.lit("block q"), key % 7, F.lit(";"))
    blocks = t.lineitem.select("l_orderkey", (F.col("l_partkey") % 5).alias("owner"), text.alias("block")).distinct()
    quotes = t.lineitem.select("l_orderkey", F.col("l_orderkey").alias("quote_id"), F.concat(F.lit("q"), key % 7, F.lit(";")).alias("quote")).distinct()
    return mt.unique_owner(quotes, blocks, "quote_id", "l_orderkey", "quote", "block", "owner")


@query("""WITH s AS (SELECT l_orderkey, (l_partkey % 400)::INT AS s, (l_partkey % 400 + l_suppkey % 5 * 100)::INT AS e FROM lineitem), g AS (SELECT l_orderkey, min(s) AS s, max(e) AS e FROM s WHERE e - s <= 300 GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN e - s <= 300 THEN s END AS start_year, CASE WHEN e - s <= 300 THEN e END AS end_year FROM g""")
def section_dominant_date(t: Tables) -> DataFrame:
    s = (F.col("l_partkey") % 400).cast("int")
    rows = t.lineitem.select("l_orderkey", s.alias("start"), (s + F.col("l_suppkey") % 5 * 100).cast("int").alias("end"))
    return rc.section_dates(rows, ["l_orderkey"]).select("l_orderkey", F.col("start").alias("start_year"), F.col("end").alias("end_year"))


def matched_rows(t: Tables) -> DataFrame:
    """Order lines in the form of matched finds; some names are catalogue numbers or single words."""
    k, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    start: Column = (k * 37 % 700 - 100).cast("int")
    rows = t.lineitem.join(t.part.select("p_partkey", "p_name", "p_brand"), p == F.col("p_partkey"))
    name = F.when(k % 7 == 0, F.concat(F.lit("27-3/"), k % 40)).when((k % 7 == 1) & (p % 3 != 0), F.split("p_name", " ")[0]).otherwise(F.col("p_name"))
    about = F.when(k % 17 == 0, "medieval pit ").when(k % 19 == 0, "pp. 3 ").otherwise("text ")
    return rows.select(
        (F.col("l_suppkey") % 50).cast("string").alias("report_id"), n.alias("chunk_no"), (k % 1000).cast("int").alias("start_char"), F.concat(F.lit("Site "), k % 4).alias("site_name"), (p % 9).cast("int").alias("page"),
        name.alias("pottery"), F.when(p % 3 == 0, F.col("p_brand")).alias("typology"), (F.col("l_returnflag") == "R").alias("is_generic"), (F.col("l_quantity") > 40).alias("is_tabular"), (F.col("l_discount") > 0.07).alias("has_marker"),
        F.when(k % 6 != 0, start).alias("start_date"), F.when(n % 4 != 0, start + 120).cast("int").alias("end_date"), F.lit("typology").alias("date_method"), F.concat(about, k % 300).alias("original_text"),
    )


@query("""WITH x AS (SELECT (l_suppkey % 50)::VARCHAR AS report, l_linenumber AS chunk, (l_orderkey % 1000)::INT AS pos, 'Site ' || l_orderkey % 4 AS site, (l_partkey % 9)::INT AS page, p_name AS pottery, CASE WHEN l_partkey % 3 = 0 THEN p_brand END AS typ,
  l_returnflag = 'R' AS general, l_quantity > 40 AS tab, l_discount > 0.07 AS mark, CASE WHEN l_orderkey % 6 <> 0 THEN (l_orderkey * 37 % 700 - 100)::INT END AS s, CASE WHEN l_linenumber % 4 <> 0 THEN (l_orderkey * 37 % 700 + 20)::INT END AS e,
  CASE WHEN l_orderkey % 17 = 0 THEN 'medieval pit ' WHEN l_orderkey % 19 = 0 THEN 'pp. 3 ' ELSE 'text ' END || l_orderkey % 300 AS text, l_orderkey AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
p AS (SELECT * REPLACE (CASE WHEN k % 7 = 0 THEN '27-3/' || k % 40 WHEN k % 7 = 1 AND typ IS NULL THEN string_split(pottery, ' ')[1] ELSE pottery END AS pottery) FROM x),
a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY report, lower(pottery), typ, pos ORDER BY chunk, pos, site, page, s NULLS FIRST, e NULLS FIRST, text, general, tab, mark) = 1), b AS (SELECT * FROM a WHERE typ IS NOT NULL OR NOT starts_with(text, 'pp. ')),
c AS (SELECT * FROM b QUALIFY NOT starts_with(pottery, '27-3/') OR row_number() OVER (PARTITION BY report, starts_with(pottery, '27-3/'), pottery, typ, site, s, e ORDER BY chunk, pos, site, page, s NULLS FIRST, e NULLS FIRST, text, general, tab, mark) = 1),
d AS (SELECT * FROM c WHERE typ IS NOT NULL OR NOT EXISTS (SELECT 1 FROM c o WHERE o.report = c.report AND o.typ IS NOT NULL AND o.text = c.text AND contains(lower(o.pottery), lower(c.pottery)))),
f AS (SELECT * FROM d QUALIFY typ IS NOT NULL OR NOT general OR NOT bool_or(typ IS NULL AND NOT general) OVER (PARTITION BY report, lower(pottery), site)),
g AS (SELECT * FROM f QUALIFY tab OR NOT mark OR NOT bool_or(tab) OVER (PARTITION BY report, page, lower(coalesce(typ, pottery)))),
h AS (SELECT *, CASE WHEN s IS NULL AND e >= -12 THEN -12 ELSE s END AS s2, CASE WHEN e IS NULL AND s <= 450 THEN 450 ELSE e END AS e2 FROM g)
SELECT report AS report_id, chunk AS chunk_no, pos AS start_char, pottery, typ AS typology, s2 AS start_date, e2 AS end_date, text AS original_text
FROM h WHERE (s2 IS NULL AND e2 IS NULL AND NOT starts_with(text, 'medieval')) OR (coalesce(s2, -99999) < 450 AND coalesce(e2, 99999) > -52 AND NOT (s2 IS NULL AND e2 IS NULL))""")
def summary_rows(t: Tables) -> DataFrame:
    """The cascade over order lines whose names are also catalogue numbers and single words."""
    rows = matched_rows(t)
    return rc.summary_rows(rows).select("report_id", "chunk_no", "start_char", "pottery", "typology", "start_date", "end_date", "original_text")


@query()
def summary_cascade(t: Tables) -> DataFrame:
    return rc.summary_cascade(matched_rows(t))
