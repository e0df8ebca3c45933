"""Queries over vocabularies and their matches: part names as wares, document words as terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as pr
from ..functions import text as tx
from ..operators import matching as mt
from ..operators import records as rc
from ..operators import sections as sc
from ..operators import spans as sp
from ..operators import triggers as tr
from .catalogue import Tables, query

#: A vocabulary of words that the supplied texts hold, one inside another.
TERMS = {"P1": ("[Tt]hen", "A"), "P2": ("[Ii]n", "B"), "P3": ("[Tt]he", "A"), "P4": ("inger", "C"), "P5": ("[Oo]nth", None)}
PATTERNS = [{"pattern_id": k, "regex": r, "hint": h} for k, (r, h) in TERMS.items()]
_SPEC = ", ".join(f"({i}, '{k}', '{r}', {'NULL' if h is None else repr(h)})" for i, (k, (r, h)) in enumerate(TERMS.items()))
CHUNK_SQL = """c AS (SELECT doc_id, o AS off, (o / 1050)::INT AS chunk_no, CASE WHEN length(text) <= 1200 THEN text ELSE trim(substr(text, (o + 1)::BIGINT, 1200), E' \\n\\t\\r') END AS t
  FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 1200 THEN [0] ELSE range(0, (ceil((length(text) - 1200) / 1050.0) * 1050 + 1)::BIGINT, 1050) END) AS o FROM documents WHERE length(text) > 0))"""


def span_sql(spec: str) -> str:
    return f"""{CHUNK_SQL}, v(pattern_no, pattern_id, regex, hint) AS (VALUES {spec}),
m AS (SELECT doc_id, off, chunk_no, pattern_no, pattern_id, hint, regexp_extract_all(t, regex) AS f, string_split_regex(t, regex) AS g FROM c, v WHERE regexp_matches(t, regex)),
e AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m),
s AS (SELECT doc_id, off, chunk_no, pattern_no, pattern_id, hint, f[i] AS term,
  (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(f[1:i], lambda x: length(x))) - length(f[i]))::INT AS a,
  (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(f[1:i], lambda x: length(x))))::INT AS b FROM e)"""


def spans(t: Tables) -> DataFrame:
    return sp.scan(sc.chunks(t.documents.select("doc_id", "text")).drop("text"), PATTERNS)


@query(f"WITH {span_sql(_SPEC)} SELECT pattern_id, count(*) AS n, sum(a)::BIGINT AS sum_start, count(DISTINCT doc_id) AS n_docs FROM s GROUP BY pattern_id")
def pattern_scan_counts(t: Tables) -> DataFrame:
    return spans(t).groupBy("pattern_id").agg(F.count("*").alias("n"), F.sum("start").alias("sum_start"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"""WITH {span_sql(_SPEC)}, d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, off + a, off + b, lower(term), hint ORDER BY chunk_no, pattern_no, a) AS n FROM s)
SELECT doc_id, count(*) AS n_spans, sum(off + a)::BIGINT AS sum_start, count(*) FILTER (hint IS NULL) AS n_unmapped FROM d WHERE n = 1 GROUP BY doc_id""")
def candidate_dedup(t: Tables) -> DataFrame:
    out = sp.dedup_in_section(spans(t), ["doc_id"])
    return out.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum("abs_start").alias("sum_start"), F.count_if(F.col("hint").isNull()).alias("n_unmapped"))


@query(f"""WITH {span_sql(_SPEC)}, k AS (SELECT * FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.doc_id = x.doc_id AND y.chunk_no = x.chunk_no AND y.a <= x.a AND y.b >= x.b AND y.b - y.a > x.b - x.a))
SELECT doc_id, chunk_no, count(*) AS n, sum(a)::BIGINT AS sum_start FROM k GROUP BY ALL""")
def span_containment(t: Tables) -> DataFrame:
    kept = sp.drop_contained(spans(t), ["doc_id", "chunk_no"])
    return kept.groupBy("doc_id", "chunk_no").agg(F.count("*").alias("n"), F.sum("start").alias("sum_start"))


@query(f"""WITH {span_sql(_SPEC)}, x AS (SELECT * FROM s WHERE pattern_id IN ('P2', 'P3')), y AS (SELECT * FROM s WHERE pattern_id NOT IN ('P2', 'P3'))
SELECT doc_id, chunk_no, count(*) AS n FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.doc_id = x.doc_id AND y.chunk_no = x.chunk_no AND y.a <= x.a AND y.b >= x.b) GROUP BY ALL""")
def trigger_coverage(t: Tables) -> DataFrame:
    found = spans(t)
    mine = F.col("pattern_id").isin("P2", "P3")
    free = sp.not_covered(found.where(mine), found.where(~mine), ["doc_id", "chunk_no"])
    return free.groupBy("doc_id", "chunk_no").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS w, p_size, p_partkey % 7 AS k FROM part),
t AS (SELECT id, CASE k % 3 WHEN 0 THEN 'Drag. ' || p_size || '/Drag. ' || (p_size + 1) WHEN 1 THEN 'Drag. ' || p_size || ' (Drag. ' || (p_size + 1) || ')' ELSE 'Drag. ' || p_size || '-' || (p_size + 3) END AS t, p_size, k FROM s)
SELECT id, CASE k % 3 WHEN 0 THEN t WHEN 1 THEN CASE WHEN p_size % 5 <= (p_size + 1) % 5 THEN 'Drag. ' || p_size ELSE 'Drag. ' || (p_size + 1) END ELSE t END AS term,
  CASE k % 3 WHEN 1 THEN CASE WHEN p_size % 5 <= (p_size + 1) % 5 THEN p_size ELSE p_size + 1 END ELSE p_size END::INT AS date_start FROM t""")
def adjacent_merge(t: Tables) -> DataFrame:
    """Two codes in a row, joined by a slash, a bracket or a dash; a code n dates n to n + n mod 5."""
    size, kind = F.col("p_size"), F.col("p_partkey") % 7 % 3
    one, two = F.concat(F.lit("Drag. "), size), F.concat(F.lit("Drag. "), size + 1)
    text = F.when(kind == 0, F.concat_ws("/", one, two)).when(kind == 1, F.concat(one, F.lit(" ("), two, F.lit(")"))).otherwise(F.concat(one, F.lit("-"), size + 3))
    found = sp.scan(t.part.select(F.col("p_partkey").alias("id"), text.alias("chunk_text")), [{"pattern_id": "code", "regex": r"Drag\. [0-9]+"}])
    number = F.regexp_extract("term", "[0-9]+", 0).cast("int")
    found = found.withColumns({"date_start": number, "date_end": number + number % 5})
    return sp.merge_adjacent(found, ["id"]).select("id", "term", "date_start")


@query("""SELECT p_partkey AS id, 'Drag ' || n AS term FROM (SELECT p_partkey, unnest([p_size + 1, p_size + 2]) AS n, unnest([1, 2]) AS i, p_size FROM part) WHERE n <= 40 AND (i = 1 OR p_size + 1 <= 40)""")
def enumeration_expand(t: Tables) -> DataFrame:
    size = F.col("p_size")
    text = F.concat(F.lit("found Drag "), size, F.lit(", "), size + 1, F.lit(" en "), size + 2, F.lit(" there"))
    found = sp.scan(t.part.select(F.col("p_partkey").alias("id"), text.alias("chunk_text")), [{"pattern_id": "code", "regex": "Drag [0-9]+"}])
    codes = t.spark.range(1, 41).select(F.concat(F.lit("DRAG_"), F.col("id")).alias("code"))
    return sp.expand_enumeration(found, codes).select("id", "term")


@query("""WITH i AS (SELECT p_brand AS code, p_name AS abbr, p_partkey AS pos, p_size FROM part),
k AS (SELECT upper(trim(regexp_replace(code, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS key, 0 AS prio, -pos AS o, p_size FROM i
  UNION ALL SELECT upper(trim(regexp_replace(a, '[^A-Za-z0-9]+', '_', 'g'), '_')), 1, pos, p_size FROM (SELECT unnest(string_split(abbr, ' ')) AS a, pos, p_size FROM i))
SELECT key, first(p_size ORDER BY prio, o) AS p_size FROM k WHERE key <> '' GROUP BY key""")
def abbreviation_index(t: Tables) -> DataFrame:
    vocabulary = t.part.select(F.col("p_brand").alias("code"), F.replace("p_name", F.lit(" "), F.lit("|")).alias("abbreviations"), F.col("p_partkey").alias("position"), "p_size")
    return mt.abbreviation_index(vocabulary).select("key", "p_size")


@query("""WITH m AS (SELECT upper(replace(p_brand, '#', '_')) AS key, max_by(p_size, p_partkey) AS v FROM part GROUP BY ALL)
SELECT l_orderkey, l_linenumber, coalesce(a.v, b.v) AS size_code FROM lineitem JOIN part ON l_partkey = p_partkey
LEFT JOIN m a ON a.key = 'BRAND_' || (l_quantity::INT)::VARCHAR LEFT JOIN m b ON b.key = upper(replace(p_brand, '#', '_'))""")
def typology_lookup_coalesce(t: Tables) -> DataFrame:
    vocabulary = t.part.select(F.col("p_brand").alias("code"), F.lit("").alias("abbreviations"), F.col("p_partkey").alias("position"), "p_size")
    index = mt.abbreviation_index(vocabulary).select("key", "p_size")
    rows = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    keys = [tx.canonical_code(F.concat(F.lit("Brand#"), F.col("l_quantity").cast("int").cast("string"))), tx.canonical_code(F.col("p_brand"))]
    return mt.lookup_first(rows, index, keys, "p_size", "size_code").select("l_orderkey", "l_linenumber", "size_code")


@query(r"""WITH k AS (SELECT DISTINCT lower(w[1]) AS keyword FROM (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark) UNION SELECT DISTINCT lower(w[2] || ' ' || w[3]) FROM (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark)),
d AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, (max((length(keyword), keyword)))[2] AS keyword FROM d JOIN k ON contains(t, ' ' || keyword) GROUP BY doc_id""")
def keyword_longest_match(t: Tables) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    keys = t.benchmark.select(F.explode(F.array(F.get(words, 0), F.concat_ws(" ", F.get(words, 1), F.get(words, 2)))).alias("keyword")).where("keyword <> ''")
    return mt.longest_keyword(t.documents.select("doc_id", "text"), keys, ["doc_id"])


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t FROM documents), b AS (SELECT item_id, left(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 40) AS q,
  array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:4], ' ') AS k FROM benchmark)
SELECT item_id, doc_id FROM b JOIN d ON q <> '' AND contains(t, q)""")
def quote_verify(t: Tables) -> DataFrame:
    return mt.verified_quotes(t.benchmark, t.documents, "item_id", "doc_id")


@query(r"""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
p AS (SELECT doc_id, word, pos FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM w)),
a AS (SELECT doc_id, pos FROM p WHERE word = 'with'), b AS (SELECT doc_id, pos FROM p WHERE word = 'have' OR word = 'was'),
j AS (SELECT a.doc_id, a.pos AS "at", b.pos AS near_id, abs(a.pos - b.pos) AS distance, row_number() OVER (PARTITION BY a.doc_id, a.pos ORDER BY abs(a.pos - b.pos), b.pos) AS n FROM a JOIN b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= 120)
SELECT doc_id, "at", near_id, distance FROM j WHERE n = 1""")
def nearest_pair(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "word"))
    side = lambda *w: words.where(F.col("word").isin(*w)).select("doc_id", F.col("at").cast("long").alias("at"), F.col("at").cast("long").alias("id"))
    return mt.nearest_pairs(side("with"), side("have", "was"), ["doc_id"]).select("doc_id", "at", "near_id", "distance")


@query(r"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderkey || '-' || o_custkey || '/' || o_orderkey % 17 END AS regnum FROM orders""")
def registration_numbers(t: Tables) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    number = F.concat(key, F.lit("-"), cust, F.when(key % 3 != 2, F.lit("/")).otherwise(F.lit("-")), key % 17)
    text = F.concat(F.lit("inv. --/"), number, F.lit(" and 19-16 BC"))
    return t.orders.select("o_orderkey", tx.registration_number(text).alias("regnum"))


@query(r"""SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '(?i)\b(?:in|of)\b (\w+)', 1))) AS figure_no FROM conversations WHERE regexp_matches(text, '(?i)\b(?:in|of)\b') AND regexp_matches(text, '(?i)the') AND NOT regexp_matches(text, '(?m)^\d+[.)] ')""")
def figure_catalogue(t: Tables) -> DataFrame:
    out = sp.figure_catalogue(t.conversations, marker=r"(?i)\b(?:in|of)\b", vessel="(?i)the", entry=r"(?m)^\d+[.)] ", text="text")
    return out.select("conv_id", "turn", "figure_no")


LEXICON = tr.Lexicon(triggers=("with", "hand", "that", "this", "then"), naming=(r"(?i)\b(with\s+\p{L}+)\b", r"(?i)\b(\p{L}+\s+that)\b"), vessels=("this",), indicator=r"(?i)\b(?:with|that|hand)\b")


@query()
def trigger_mentions(t: Tables) -> DataFrame:
    """Mentions around trigger words, outside the spans of the pattern scan."""
    windows = sc.chunks(t.documents.select("doc_id", "text")).drop("text").withColumn("section_no", F.lit(1))
    known = sp.scan(windows, PATTERNS[:1])
    return tr.mentions(windows, LEXICON, known, keys=("doc_id", "section_no")).select("doc_id", "abs_start", "term", "name", "context_line")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey * 10 AS pos, l_linenumber = 1 AS grp, CASE WHEN l_linenumber = 1 THEN 'p1 p2 p3' ELSE 'p' || l_partkey % 9 END AS term FROM lineitem),
y AS (SELECT *, count(*) FILTER (NOT grp AND term IN ('p1', 'p2', 'p3')) OVER (PARTITION BY l_suppkey ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 1500 FOLLOWING) AS n FROM x)
SELECT l_orderkey, l_linenumber FROM y WHERE NOT (grp AND n >= 2)""")
def list_preview_suppress(t: Tables) -> DataFrame:
    term = F.when(F.col("l_linenumber") == 1, "p1 p2 p3").otherwise(F.concat(F.lit("p"), F.col("l_partkey") % 9))
    rows = t.lineitem.withColumns({"pos": F.col("l_partkey") * 10, "term": term})
    return rc.list_previews(rows, ["l_suppkey"], "pos", "term", F.col("l_linenumber") == 1).select("l_orderkey", "l_linenumber")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'variants' WHEN 2 THEN 'synonyms' ELSE 'mixed' END AS kind, (CASE WHEN p_partkey % 4 = 2 THEN 2 ELSE 1 END)::INT AS n_codes FROM part""")
def slash_forms(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    code = F.element_at(F.array(F.concat(F.lit("Drag "), k), F.concat(F.lit("Drag "), k, F.lit("/31")), F.concat(F.lit("Drag "), k, F.lit("/Gose "), k), F.concat(F.lit("Drag "), k, F.lit("/Gose 3/44"))), (k % 4 + 1).cast("int"))
    return t.part.select("p_partkey", pr.slash_kind(code).alias("kind"), F.size(pr.slash_parts(code)).alias("n_codes"))
