"""Queries over single finds and texts: predicates, keys, contexts, labels, named periods, map points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import certainty as ct
from ..functions import cues
from ..functions import dates as dt
from ..functions import periods as pd
from ..functions import predicates as pr
from ..functions import replies as rp
from ..functions import text as tx
from ..functions import wares as wr
from ..operators import matching as mt
from ..operators import pages as pg
from ..operators import records as rc
from ..operators import sections as sc
from ..operators import summary as sm
from ..sources import readers as rd
from .catalogue import Tables, query

md5 = lambda c: F.md5(c.cast("binary"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(trim(text, ' ')), '[^a-z0-9\s-]', '', 'g'), '\s+', ' ', 'g'), ' ')) AS form_md5 FROM documents WHERE NOT regexp_matches(lower(text), '\bdrag')""")
def surface_forms(t: Tables) -> DataFrame:
    return t.documents.where(~F.lower("text").rlike(r"\bdrag")).select("doc_id", md5(tx.surface_form(F.col("text"))).alias("form_md5"))


@query("""WITH x AS (SELECT p_partkey, p_partkey % 6 + 1 AS i, p_partkey % 5 + 1 AS j, p_size FROM part)
SELECT p_partkey, ['dragendorff ', 'niederbieber ', 'haltern ', 'hofheim ', 'dressel ', 'stuart '][i] || p_size || ['', '', '', '/31', ' a'][j] AS form FROM x""")
def typology_forms(t: Tables) -> DataFrame:
    series = F.array(*map(F.lit, ("Drag. ", "NB ", "type Ha. ", "Hofh.", "cf. Dr. ", "Stuart ")))
    hedge = F.array(*map(F.lit, (" cf.", "?", " (mogelijk)", " / 31", " a")))
    code = F.concat(F.element_at(series, (F.col("p_partkey") % 6 + 1).cast("int")), "p_size", F.element_at(hedge, (F.col("p_partkey") % 5 + 1).cast("int")))
    return t.part.select("p_partkey", tx.typology_form(code).alias("form"))


@query("""SELECT doc_id, regexp_matches(lower(text), 'la|der') AND NOT regexp_matches(lower(text), 'the') AS vetoed FROM documents WHERE text IS NOT NULL""")
def label_veto(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", pr.out_of_scope_label(F.col("text"), "la|der", "the").alias("vetoed"))


@query("""SELECT p_partkey, starts_with(p_brand, 'Brand#1') OR p_type IN ('ECONOMY', 'PROMO') AS is_find,
  CASE WHEN trim(p_name, ' ') = '' THEN 'UNMAPPED' ELSE trim(p_name, ' ') END AS hint, CASE WHEN trim(p_name, ' ') <> '' THEN 'canonical_hint' ELSE 'none' END AS method FROM part""")
def find_records(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.part.select("p_partkey", pr.is_pottery_record(F.col("p_brand"), F.col("p_type"), ("ECONOMY", "PROMO"), "Brand#1").alias("is_find"), pr.canonical_hint(name).alias("hint"), pr.normalisation_method(name).alias("method"))


@query(r"""WITH x AS (SELECT doc_id, [text || ' see 4', text || ' (vgl. x)', 'In total: ' || text, text, text || ' pp. 12', text || ' nieuwe tijd'][doc_id % 6 + 1] AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, regexp_matches(s, '(?i)\b(see|zie|cf|vgl|table|tabel|fig|afb|cat)\b') AS refers, regexp_matches(s, '(?i)\b(summary|samenvatting|conclusion|conclusie|in total|in totaal|overall|overzicht)\b') AS recap,
  regexp_matches(s, '(?i)\bnieuwe tijd\b|\bpp\.\s*\d') AS modern_or_page FROM x""")
def text_markers(t: Tables) -> DataFrame:
    x = F.col("text")
    some = F.array(F.concat(x, F.lit(" see 4")), F.concat(x, F.lit(" (vgl. x)")), F.concat(F.lit("In total: "), x), x, F.concat(x, F.lit(" pp. 12")), F.concat(x, F.lit(" nieuwe tijd")))
    rows = t.documents.where("text is not null").select("doc_id", F.element_at(some, (F.col("doc_id") % 6 + 1).cast("int")).alias("s"))
    return rows.select("doc_id", pr.has_reference_marker(F.col("s")).alias("refers"), pr.has_recap_marker(F.col("s")).alias("recap"), pr.modern_or_page(F.col("s")).alias("modern_or_page"))


@query(r"""WITH x AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ')), lambda l: l <> '') AS lines FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '\b(data|name|total|number)\b'))) >= 2 OR (len(lines) >= 5 AND len(list_filter(lines, lambda l: regexp_full_match(l, '[\d\s.,/%-]+'))) >= 0.3 * len(lines)) AS tabular FROM x""")
def tabular_texts(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", tx.is_tabular(F.col("text"), ("data", "name", "total", "number")).alias("tabular"))


LABEL = "['present', 'comparison', 'uncertain', 'absent', 'irrelevant'][o_orderkey % 5 + 1]"


@query(f"""SELECT o_orderkey, CASE WHEN {LABEL} IN ('present', 'comparison') OR ({LABEL} = 'uncertain' AND o_custkey % 10 >= 5) THEN 'eligible' ELSE 'skipped_' || {LABEL} END AS status, o_custkey % 10 < 7.5 AS second_opinion FROM orders""")
def dating_gate(t: Tables) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ("present", "comparison", "uncertain", "absent", "irrelevant"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    confidence = (F.col("o_custkey") % 10) / 10
    return t.orders.select("o_orderkey", cues.eligible_for_dating(label, confidence, with_uncertain=True).alias("status"), cues.needs_second_opinion(confidence).alias("second_opinion"))


@query("""WITH x AS (SELECT p_partkey, p_size % 13 - 1 AS level, p_partkey % 4 = 0 AS hedged, CASE WHEN p_partkey % 3 = 0 THEN 'Small ' || p_name ELSE p_name END AS given FROM part),
y AS (SELECT *, regexp_replace(given, '(?i)^(small|little) +', '') AS base FROM x)
SELECT p_partkey, hedged AS tentative, (CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN hedged THEN least(4, greatest(0, least(10, level))) ELSE greatest(0, least(10, level)) END)::INT AS certainty,
  CASE WHEN base <> given AND p_partkey % 2 = 0 THEN upper(base[1]) || substr(base, 2) ELSE given END AS shown FROM y""")
def name_levels(t: Tables) -> DataFrame:
    key, name = F.col("p_partkey"), F.col("p_name")
    typology = F.when(key % 4 == 0, F.concat(F.lit("vgl. "), "p_brand")).otherwise(F.col("p_brand"))
    tentative = ct.is_tentative(typology)
    given = F.when(key % 3 == 0, F.concat(F.lit("Small "), name)).otherwise(name)
    term = F.when(key % 2 == 0, F.lit("een schaaltje")).otherwise(F.lit("een schaal"))
    return t.part.select("p_partkey", tentative.alias("tentative"), ct.name_certainty(F.col("p_size") % 13 - 1, tentative, key % 7 != 0).cast("int").alias("certainty"), ct.undiminish(given, term).alias("shown"))


@query("""WITH x AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS s, CASE WHEN p_partkey % 4 <> 0 THEN p_size + 10 END AS e, CASE WHEN p_partkey % 5 = 0 THEN '  ' WHEN p_partkey % 5 <> 1 THEN p_brand END AS typ,
  CASE WHEN p_partkey % 6 = 0 THEN ' Pottery' WHEN p_partkey % 6 = 1 THEN 'SHERDS ' ELSE p_name END AS name FROM part)
SELECT p_partkey, s IS NOT NULL AND e IS NOT NULL AS found, CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN 'vocabulary' WHEN s IS NULL AND e IS NULL THEN 'none' ELSE 'one-sided' END AS note,
  trim(coalesce(typ, ''), ' ') = '' AS untyped, CASE WHEN p_partkey % 6 < 2 THEN 'generic' ELSE lower(trim(name, ' ')) END AS bucket, s IS NOT DISTINCT FROM e AS same_ends FROM x""")
def find_predicates(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    start, end = F.when(key % 3 != 0, F.col("p_size")), F.when(key % 4 != 0, F.col("p_size") + 10)
    typ = F.when(key % 5 == 0, "  ").when(key % 5 != 1, F.col("p_brand"))
    name = F.when(key % 6 == 0, " Pottery").when(key % 6 == 1, "SHERDS ").otherwise(F.col("p_name"))
    dated = pr.vocabulary_date(start, end)
    return t.part.select("p_partkey", dated["found"].alias("found"), dated["note"].alias("note"), pr.is_untyped(typ).alias("untyped"), pr.ware_bucket(name).alias("bucket"), pr.same(start, end).alias("same_ends"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 'samian' WHEN regexp_matches(lower(p_name), '\\bblue\\b') THEN 'glass' WHEN starts_with(p_brand, 'Brand#2') THEN 'coarse' WHEN contains(lower(p_name), 'bolt') THEN 'iron' ELSE '' END AS family FROM part""")
def ware_families(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", pr.family(F.col("p_name"), F.col("p_brand"), {"red": "samian", r"\bblue\b": "glass"}, {"bolt": "iron"}, {"^brand#2": "coarse"}).alias("family"))


YEARS = "SELECT o_orderkey, (o_orderkey * 37 % 500 - 52)::INT AS a, (o_orderkey * 37 % 500 - 52 + o_custkey % 4 * 30)::INT AS b, (o_custkey % 300 - 40)::INT AS c FROM orders"


@query(f"""WITH x AS ({YEARS}), f AS (SELECT *, CASE WHEN a < 0 THEN -a || ' BC' ELSE 'AD ' || a END AS fa, CASE WHEN b < 0 THEN -b || ' BC' ELSE 'AD ' || b END AS fb FROM x)
SELECT o_orderkey, CASE WHEN a = b THEN fa ELSE fa || ' - ' || fb END AS label, a <= c + 50 AND c <= b AS meets, (CASE WHEN b - a <= 50 THEN a ELSE c END)::INT AS narrowest_start FROM f""")
def year_labels(t: Tables) -> DataFrame:
    a = ((F.col("o_orderkey") * 37) % 500 - 52).cast("int")
    b, c = (a + F.col("o_custkey") % 4 * 30).cast("int"), (F.col("o_custkey") % 300 - 40).cast("int")
    both = F.array(dt.year_range(a, b), dt.year_range(c, c + 50))
    return t.orders.select("o_orderkey", dt.format_range(a, b).alias("label"), dt.overlaps(a, b, c, c + 50).alias("meets"), dt.narrowest(both)["start"].cast("int").alias("narrowest_start"))


@query("""SELECT event_id, 2 AS n_objects, (json_extract(props, '$.k')::BIGINT) AS k, event_type AS label FROM events""")
def reply_objects(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Here you are: ["), "props", F.lit(", "), "props", F.lit(', {"k": 1, "cut'))
    rows = t.events.select("event_id", rp.json_objects(text).alias("o"), rp.rescued_label(F.concat(F.lit("the label: "), "event_type", F.lit(" (sure)")), ("click", "error", "purchase", "signup", "view")).alias("label"))
    return rows.select("event_id", F.size("o").alias("n_objects"), F.get_json_object(F.col("o")[0], "$.k").cast("long").alias("k"), "label")


@query(r"""WITH x AS (SELECT doc_id, text, (doc_id * 131 % greatest(1, length(text)))::INT AS s, regexp_extract(text, '^[^,;:.]*') AS clause FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(substr(text, greatest(0, s - 300) + 1, s + 20 + 300 - greatest(0, s - 300))) AS context_md5, md5(clause) AS clause_md5 FROM x""")
def char_contexts(t: Tables) -> DataFrame:
    at = (F.col("doc_id") * 131 % F.greatest(F.lit(1), F.length("text"))).cast("int")
    rows = t.documents.where("text is not null").withColumn("at", at)
    return rows.select("doc_id", md5(sc.context(F.col("text"), F.col("at"), F.col("at") + 20)).alias("context_md5"), md5(sc.clause_after(F.col("text"))).alias("clause_md5"))


@query("""WITH x AS (SELECT doc_id, text, substr(text, (doc_id * 17 % 2000)::INT + 1, 90) || CASE WHEN doc_id % 3 = 0 THEN '#' ELSE '' END AS q FROM documents WHERE length(text) > 2100),
y AS (SELECT *, CASE WHEN strpos(text, q) > 0 THEN strpos(text, q) WHEN strpos(text, left(q, 60)) > 0 THEN strpos(text, left(q, 60)) END AS at FROM x)
SELECT doc_id, md5(substr(text, greatest(1, at - 240), at + length(q) + 240 - greatest(1, at - 240))) AS context_md5 FROM y""".replace(" AS at FROM", " AS pos FROM").replace("at - 240", "pos - 240").replace("at + length", "pos + length"))
def quote_contexts(t: Tables) -> DataFrame:
    cut = F.substring("text", (F.col("doc_id") * 17 % 2000).cast("int") + 1, F.lit(90))
    rows = t.documents.where("length(text) > 2100").withColumn("q", F.concat(cut, F.when(F.col("doc_id") % 3 == 0, "#").otherwise("")))
    return rows.select("doc_id", md5(sc.quote_context(F.col("text"), F.col("q"))).alias("context_md5"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, line, min(i) AS i FROM l WHERE regexp_matches(line, '(?i)^(la|der|the|de) ') GROUP BY ALL), s AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS caps FROM c GROUP BY doc_id)
SELECT d.doc_id, md5(left(left(text, 1500) || chr(10) || coalesce(caps, ''), 3000)) AS focus_md5 FROM documents d LEFT JOIN s USING (doc_id) WHERE text IS NOT NULL""")
def site_focus(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", md5(sc.site_focus(F.col("text"), caption="(?i)^(?:la|der|the|de) ")).alias("focus_md5"))


@query("""WITH b AS (SELECT l_orderkey AS report_id, l_suppkey % 3 AS page, 'b' || l_partkey || CASE WHEN l_linenumber % 3 = 0 THEN ' one two three four five six' ELSE '' END AS text, l_linenumber * 1000000 + l_partkey AS n, l_partkey % 100 * 10.0 AS y0, l_partkey % 100 * 10.0 + 8 + l_quantity AS y1 FROM lineitem),
w AS (SELECT *, lead(y0) OVER o - y1 AS below, y0 - lag(y1) OVER o AS above FROM b WINDOW o AS (PARTITION BY report_id, page ORDER BY y0, n))
SELECT report_id, page, text FROM w WHERE length(text) <= 30 AND len(list_filter(string_split(text, ' '), lambda x: x <> '')) <= 5 AND ((y1 <= 80 AND coalesce(below >= 30, true)) OR (y0 >= 920 AND coalesce(above >= 30, true)))""")
def marginal_blocks(t: Tables) -> DataFrame:
    y0 = (F.col("l_partkey") % 100 * 10).cast("double")
    text = F.concat(F.lit("b"), "l_partkey", F.when(F.col("l_linenumber") % 3 == 0, " one two three four five six").otherwise(""))
    blocks = t.lineitem.select(F.col("l_orderkey").alias("report_id"), (F.col("l_suppkey") % 3).alias("page"), text.alias("text"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("x0"), y0.alias("y0"), (y0 + 8 + F.col("l_quantity")).alias("y1"), F.lit(1000.0).alias("page_height"))
    return pg.marginalia(blocks, keys=("report_id", "page")).select("report_id", "page", "text")


def points(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    return t.customer.select((key % 900).alias("site_id"), (key % 900 % 70 * 4.0).alias("x_km"), (key % 900 % 90 * 5.0).alias("y_km"), F.concat(F.lit("place "), key % 900 % 40).alias("toponym"), (key % 900).alias("map_number"))


@query("""WITH p AS (SELECT DISTINCT c_custkey % 900 AS site_id, c_custkey % 900 % 70 * 4.0 AS x_km, c_custkey % 900 % 90 * 5.0 AS y_km, 'place ' || c_custkey % 900 % 40 AS toponym FROM customer),
o AS (SELECT * FROM p WHERE x_km BETWEEN 20 AND 200 AND y_km BETWEEN 50 AND 300 AND site_id NOT IN (SELECT s_suppkey FROM supplier))
SELECT toponym, string_agg(site_id::VARCHAR, ', ' ORDER BY site_id) AS numbers, min(site_id) AS first_number FROM o GROUP BY toponym""")
def other_sites(t: Tables) -> DataFrame:
    boxed = rd.in_box(points(t), 20, 200, 50, 300)
    return rd.map_labels(rd.without_targets(boxed, t.supplier.select(F.col("s_suppkey").alias("site_id"))))


@query("""WITH x AS (SELECT p_partkey, p_partkey % 7 + 1 AS i, string_split(p_name, ' ') AS w, p_brand, p_partkey % 9 = 0 AS typed FROM part),
k AS (SELECT *, [list_transform(w, lambda x: CASE WHEN length(x) > 4 AND ends_with(x, 's') THEN left(x, length(x) - 1) ELSE x END)] AS s FROM x)
SELECT p_partkey, CASE WHEN typed THEN upper(replace(p_brand, '#', '_')) ELSE array_to_string(s[1], '') || ['beaker', 'mortarium', 'flagon', 'dolium', 'plate', 'bowl', 'flagon'][i] END AS ware FROM k""")
def ware_keys(t: Tables) -> DataFrame:
    form = F.array(*map(F.lit, ("Beakers", "Grinding bowls", "JUG", "dolia (Gaul)", "coarse oxidised plates", "fine bowl", "Kannen")))
    name = F.concat_ws(" ", "p_name", F.element_at(form, (F.col("p_partkey") % 7 + 1).cast("int")))
    return t.part.select("p_partkey", wr.find_key(name, F.when(F.col("p_partkey") % 9 == 0, F.col("p_brand"))).alias("ware"))


#: Named periods with made-up years, in no order; ``dawn age`` is also a reign.
NAMED = [("Dawn tijd", -50, 20), ("noon period", 20, 200), ("late noon era", 150, 200), ("dusk", 200, 450), ("dawn age", -10, 15)]


@query("""WITH x AS (SELECT doc_id, doc_id % 6 AS k, substr(regexp_replace(coalesce(text, ''), '[^b-c]', '', 'g'), 1, 50) AS t FROM documents)
SELECT doc_id, (CASE k WHEN 0 THEN -50 WHEN 1 THEN -10 WHEN 2 THEN -50 WHEN 3 THEN 150 WHEN 4 THEN 20 END)::INT AS start_year, (CASE k WHEN 0 THEN 20 WHEN 1 THEN 15 WHEN 2 THEN 450 WHEN 3 THEN 200 WHEN 4 THEN 450 END)::INT AS end_year FROM x""")
def named_periods(t: Tables) -> DataFrame:
    filler = F.left(F.regexp_replace(F.coalesce("text", F.lit("")), "[^b-c]", ""), F.lit(50))
    ends = F.array(*map(F.lit, (" the Dawn tijdperk", " DAWN EPOCH or dusk", " dawn tijdvak t/m dusk", " late noon epoch in the noon age", " dusk tot noon age, tot en met dusk", " nothing")))
    text = F.concat(filler, F.element_at(ends, (F.col("doc_id") % 6 + 1).cast("int")))
    found = pd.named_period(text, NAMED)
    return t.documents.select("doc_id", found["start"].alias("start_year"), found["end"].alias("end_year"))


@query("""WITH p AS (SELECT p_partkey AS pos, p_size AS s, p_size + p_partkey % 40 AS e, p_partkey % 5 = 0 AS reign, unnest(['term ' || p_partkey % 100, 'word ' || p_partkey % 30]) AS term FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY CASE WHEN reign THEN 0 ELSE 1 END, CASE WHEN reign THEN s - e ELSE e - s END, CASE WHEN reign THEN -pos ELSE pos END) AS n FROM p)
SELECT term, s AS start_year, e AS end_year FROM r WHERE n = 1""")
def period_overrides(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    rows = t.part.select(key.alias("position"), F.col("p_size").alias("start"), (F.col("p_size") + key % 40).alias("end"), F.when(key % 5 == 0, "emperor").otherwise("period").alias("kind"), F.array(F.concat(F.lit("term "), key % 100), F.concat(F.lit("word "), key % 30)).alias("terms"))
    return pd.override_terms(rows).select("term", F.col("start").alias("start_year"), F.col("end").alias("end_year"))


@query("""SELECT o_orderkey, (CASE o_orderkey % 4 WHEN 0 THEN o_custkey % 90 + 10 WHEN 1 THEN 150 WHEN 2 THEN 20 END)::INT AS start_year, (CASE o_orderkey % 4 WHEN 0 THEN o_custkey % 90 + 30 WHEN 1 THEN 200 WHEN 2 THEN 200 END)::INT AS end_year FROM orders""")
def quote_dates(t: Tables) -> DataFrame:
    a = F.col("o_custkey") % 90 + 10
    own = F.concat(F.lit("sherds, 1st to 3rd century AD, or AD "), a, F.lit("-"), a + 20)
    quote = F.element_at(F.array(own, F.lit("late noon wall in noon soil"), F.lit("of the Noon"), F.lit("no date")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    found = pd.quote_date(F.col("q"), dt.date_signals(F.col("q")), [(["noon", "midday"], 20, 200), (["late noon"], 150, 200), ([], 0, 1)])
    return t.orders.select("o_orderkey", quote.alias("q")).select("o_orderkey", found["start"].alias("start_year"), found["end"].alias("end_year"))


@query("""WITH v AS (SELECT DISTINCT p_brand AS code, substr(p_brand, 7)::INT AS n FROM part WHERE p_size % 2 = 0),
x AS (SELECT p_partkey, ['Brand#' || p_size % 60, 'Brand#' || (p_size + 7) % 60, p_brand] AS parts FROM part), u AS (SELECT p_partkey, unnest(parts) AS code, unnest(range(3)) AS i FROM x),
f AS (SELECT p_partkey, min((i, n)) AS b FROM u JOIN v USING (code) GROUP BY p_partkey) SELECT p_partkey, b[2] AS date_start FROM part LEFT JOIN f USING (p_partkey)""")
def grouped_typologies(t: Tables) -> DataFrame:
    index = t.part.where("p_size % 2 = 0").select(tx.canonical_code(F.col("p_brand")).alias("key"), F.substring("p_brand", 7, 9).cast("int").alias("n")).distinct()
    group = F.concat_ws(" / ", F.concat(F.lit("Brand#"), F.col("p_size") % 60), F.concat(F.lit("brand "), (F.col("p_size") + 7) % 60), "p_brand")
    parts = F.transform(F.split(group, "/"), lambda p: tx.canonical_code(F.trim(p)))
    return mt.lookup_parts(t.part.select("p_partkey", parts.alias("parts")), index, "parts", "n", "date_start").select("p_partkey", "date_start")


@query("""WITH x AS (SELECT o_orderkey AS k, ['present', 'comparison', 'uncertain', 'absent'][o_orderkey % 4 + 1] AS label, (o_custkey % 10) / 10.0 AS conf, CASE WHEN o_orderkey % 3 <> 0 THEN 100 END AS vs, CASE WHEN o_orderkey % 3 <> 0 THEN 300 END AS ve, o_custkey % 5 AS s FROM orders),
y AS (SELECT *, CASE s WHEN 0 THEN NULL ELSE s * 100 - 60 END AS ts, CASE s WHEN 0 THEN NULL ELSE s * 100 - 20 END AS te FROM x),
m AS (SELECT *, CASE WHEN label IN ('uncertain', 'absent') THEN 'skipped_' || label WHEN vs IS NULL AND ts IS NULL THEN 'unassigned' WHEN ts IS NULL THEN 'typological_direct' WHEN vs IS NULL THEN 'text_only' WHEN te < vs OR ts > ve THEN 'conflict_flagged' ELSE 'combined_narrowed' END AS method FROM y)
SELECT k AS o_orderkey, method, (CASE method WHEN 'text_only' THEN ts WHEN 'combined_narrowed' THEN ts WHEN 'typological_direct' THEN vs WHEN 'conflict_flagged' THEN vs END)::INT AS start_year,
  (CASE method WHEN 'text_only' THEN te WHEN 'combined_narrowed' THEN te WHEN 'typological_direct' THEN ve WHEN 'conflict_flagged' THEN ve END)::INT AS end_year,
  (CASE method WHEN 'text_only' THEN 0.7 WHEN 'combined_narrowed' THEN least(conf, 0.95) WHEN 'typological_direct' THEN least(conf, 0.9) WHEN 'conflict_flagged' THEN 0.3 ELSE 0 END)::DOUBLE AS confidence FROM m""")
def dated_mentions(t: Tables) -> DataFrame:
    key, s = F.col("o_orderkey"), (F.col("o_custkey") % 5).cast("int")
    label = F.element_at(F.array(*map(F.lit, ("present", "comparison", "uncertain", "absent"))), (key % 4 + 1).cast("int"))
    signal = F.struct(F.lit("x").alias("expression"), (s * 100 - 60).alias("start"), (s * 100 - 20).alias("end"), F.lit("century_expression").alias("date_type"), F.lit("medium").alias("precision"))
    rows = t.orders.select("o_orderkey", label.alias("context_label"), ((F.col("o_custkey") % 10) / 10).alias("context_confidence"), F.when(key % 3 != 0, F.lit(100)).alias("vocab_start"), F.when(key % 3 != 0, F.lit(300)).alias("vocab_end"), F.filter(F.array(signal), lambda x: s != 0).alias("signals"))
    return rc.date_mentions(rows).select("o_orderkey", "chronology.method", F.col("chronology.start").alias("start_year"), F.col("chronology.end").alias("end_year"), "chronology.confidence")


PHRASES = ("AD 70-120, of the 2nd century AD", "late noon age of a wall of the 1st to 3rd century AD", "of the Noon period", "dawn tijd t/m dusk", "no date", "3rd century")


def finds(t: Tables) -> DataFrame:
    """Order lines as mentions with dates: orders are chunks."""
    k, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    say = lambda at: F.element_at(F.array(*map(F.lit, PHRASES)), (at % 6 + 1).cast("int"))
    kind = F.when(p % 7 == 0, "generic").when(p % 2 == 0, "typology").otherwise("name")
    span = lambda cond, a, b: F.when(cond, F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    return lines.select(
        k.alias("chunk"), (n * 1000000 + p).alias("mention_id"), kind.alias("kind"), (n * 1000000 + p).alias("position"), (p % 400).cast("int").alias("start_char"), (p % 400 + 9).cast("int").alias("end_char"),
        F.when(p % 3 == 0, F.concat(F.lit("known "), p % 5)).otherwise("").alias("known"), F.concat(F.lit("ware "), p % 11).alias("label"), (p % 5 == 0).alias("is_form"), F.concat(F.lit("T "), p % 60).alias("typology"),
        F.when(p % 10 == 0, F.lit(100)).alias("vocab_start"), F.when(p % 10 == 0, F.lit(300)).alias("vocab_end"), (p % 7 == 0).alias("is_generic"), say(p).alias("sentence"), say(k).alias("around"),
        span(k % 4 == 0, 150, 250).alias("section_date"), span(k % 5 == 0, 160, 260).alias("model_date"), span(k % 3 == 0, 0, 400).alias("assigned_date"),
        F.lit("present").alias("context_label"), ((p % 10) / 10).alias("context_confidence"), F.concat(F.lit("T "), p % 60).alias("term"),
    )


#: What each phrase gives: an explicit range, and the narrower of its century and its named period.
PHRASE_SQL = """ph(i, xs, xe, os, oe, om) AS (VALUES (0, 70, 120, 101, 200, 'text_century'), (1, NULL, NULL, 150, 200, 'chron_vocab'), (2, NULL, NULL, 20, 200, 'chron_vocab'),
  (3, NULL, NULL, -50, 450, 'chron_vocab'), (4, NULL, NULL, NULL, NULL, NULL), (5, NULL, NULL, 201, 300, 'text_century')),
m AS (SELECT DISTINCT l_orderkey AS k, l_linenumber * 1000000 + l_partkey AS id, l_partkey AS p FROM lineitem),
d AS (SELECT k, id, p, CASE WHEN p % 7 = 0 THEN NULL WHEN p % 10 = 0 THEN (100, 300, 'typology') WHEN a.xs IS NOT NULL THEN (a.xs, a.xe, 'text_explicit') WHEN b.xs IS NOT NULL THEN (b.xs, b.xe, 'text_explicit')
  WHEN a.om IS NOT NULL THEN (a.os, a.oe, a.om) WHEN b.om IS NOT NULL THEN (b.os, b.oe, b.om) WHEN k % 4 = 0 THEN (150, 250, 'section_phase') WHEN k % 5 = 0 THEN (160, 260, 'llm_context') WHEN k % 3 = 0 THEN (0, 400, 'typology') END AS date
  FROM m JOIN ph a ON a.i = p % 6 JOIN ph b ON b.i = k % 6)"""


@query(f"""WITH {PHRASE_SQL} SELECT k AS chunk, id AS mention_id, date[1]::INT AS start_year, date[2]::INT AS end_year, date[3]::VARCHAR AS method FROM d""")
def dated_finds(t: Tables) -> DataFrame:
    out = sm.best_dates(finds(t), ["sentence", "around"], NAMED)
    return out.select("chunk", "mention_id", F.col("date.start").alias("start_year"), F.col("date.end").alias("end_year"), "date.method")


@query()
def pottery_rows(t: Tables) -> DataFrame:
    rows = sm.build_rows(sm.best_dates(finds(t), ["sentence", "around"], NAMED), ["chunk"])
    return rows.select("chunk", "mention_id", "kind", "pottery", "typology", "term_found", "start_date", "end_date", "date_method", "pot_name_certainty_level", "dates_certainty_level", "overall_certainty_level")
