"""Queries over texts: documents as pages of their source, conversations as marked-up lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import pages as pg
from ..operators import sections as sc
from .catalogue import Tables, query


def reports(t: Tables) -> DataFrame:
    return t.documents.select(F.col("source").alias("report_id"), F.col("doc_id").alias("page_number"), "text")


LINE_SQL = """l AS (SELECT source, doc_id, line, pos FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)),
n AS (SELECT *, regexp_replace(trim(line, ' '), '^[0-9]+[ \\t]*[/.-][ \\t]*', '') AS norm FROM l),
c AS (SELECT source, norm, count(DISTINCT doc_id) AS n_pages FROM n WHERE length(norm) >= 15 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2),
s AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
r AS (SELECT c.* FROM c JOIN s USING (source) WHERE n_pages >= greatest(2, floor(pages * 0.02)))"""


@query(f"WITH {LINE_SQL} SELECT source AS report_id, norm, n_pages FROM r")
def repeating_lines(t: Tables) -> DataFrame:
    return pg.repeating_lines(reports(t), share=0.02)


@query(f"""WITH {LINE_SQL} SELECT source AS report_id, doc_id AS page_number, md5(string_agg(line, chr(10) ORDER BY pos)) AS text_md5, count(*) AS n_lines
FROM n ANTI JOIN r USING (source, norm) GROUP BY ALL""")
def strip_repeating(t: Tables) -> DataFrame:
    out = pg.strip_repeating_lines(reports(t), share=0.02)
    return out.select("report_id", "page_number", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size(tx.lines_of(F.col("text"))).cast("long").alias("n_lines"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[\t\f]+', ' ', 'g'), ' {2,}', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: NOT regexp_matches(lower(x), '^page +[0-9]+$')), chr(10)) AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\n{3,}', E'\n\n', 'g'), '[–—]', '-', 'g'), '[ \n]+\.', '.', 'g') AS t FROM b)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(t, '[ \n]*,[ \n]*', ', ', 'g'), '[ \n]{2,}', ' ', 'g'), ' ')) AS text_md5 FROM c""")
def clean_text_basic(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(tx.clean_text_plain(F.col("text")).cast("binary")).alias("text_md5"))


@query()
def clean_text_full(t: Tables) -> DataFrame:
    out = pg.clean_pages(reports(t))
    return out.select("report_id", "page_number", tx.modern_spelling(F.col("text")).alias("text"))


@query("""WITH w AS (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 1200 THEN [0] ELSE range(0, (ceil((length(text) - 1200) / 1050.0) * 1050 + 1)::BIGINT, 1050) END) AS text_offset_start FROM documents WHERE length(text) > 0),
x AS (SELECT doc_id, text_offset_start, length(text) <= 1200 AS is_full_section, CASE WHEN length(text) <= 1200 THEN text ELSE trim(substr(text, (text_offset_start + 1)::BIGINT, 1200), E' \\n\\t\\r') END AS c FROM w)
SELECT doc_id, (text_offset_start / 1050)::INT AS chunk_no, text_offset_start::INT AS text_offset_start, is_full_section, md5(c) AS chunk_md5 FROM x WHERE c <> ''""")
def chunk_windows(t: Tables) -> DataFrame:
    out = sc.chunks(t.documents.select("doc_id", "text"))
    return out.select("doc_id", "chunk_no", "text_offset_start", "is_full_section", F.md5(F.col("chunk_text").cast("binary")).alias("chunk_md5"))


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '\. +')) AS sentence, unnest(range(len(string_split_regex(text, '\. +')))) AS n FROM documents)
SELECT doc_id, n::INT AS sentence_no, length(sentence)::INT AS n_chars,
  md5(string_agg(sentence, ' ') OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS context_md5,
  md5(string_agg(sentence, ' ') OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS forward_md5 FROM s""")
def sentence_context(t: Tables) -> DataFrame:
    rows = sc.sentences(t.documents.select("doc_id", "text"), pattern=r"\. +").drop("text")
    both = sc.around(sc.around(rows, ["doc_id"], 2, 2), ["doc_id"], 0, 4, out="forward")
    return both.select("doc_id", "sentence_no", F.length("sentence").alias("n_chars"), F.md5(F.col("context").cast("binary")).alias("context_md5"), F.md5(F.col("forward").cast("binary")).alias("forward_md5"))


@query("""WITH a AS (SELECT conv_id, turn, role, trim(replace(text, chr(10), ' '), ' ') AS line FROM conversations),
b AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS section_no FROM a WHERE line <> ''),
p AS (SELECT * FROM b WHERE role <> 'user')
SELECT conv_id, section_no, min(page_start) AS page_start, max(page_end) AS page_end, sum(length(line) + 1) - 1 AS n_chars, md5(string_agg(line, chr(10) ORDER BY turn)) AS text_md5
FROM p JOIN (SELECT conv_id, section_no, min(turn) AS page_start, max(turn) AS page_end FROM b GROUP BY ALL) USING (conv_id, section_no) GROUP BY ALL""")
def sectionise_islands(t: Tables) -> DataFrame:
    lines = t.conversations.select("conv_id", "turn", F.trim(F.replace("text", F.lit("\n"), F.lit(" "))).alias("line"), "role").where("line <> ''")
    none = F.lit(None).cast("string")
    heading = F.when(F.col("role") == "user", F.struct(F.col("line").alias("title"), none.alias("site"), none.alias("rest")))
    out = sc.sections(lines.withColumn("heading", heading), ["conv_id"], ["turn"], "turn")
    return out.select("conv_id", "section_no", "page_start", "page_end", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query()
def sectionise_headings(t: Tables) -> DataFrame:
    """Sections of each source's documents, with page breaks carried into their windows."""
    lines = pg.lines(reports(t)).withColumn("page", F.col("page_number"))
    marked = sc.mark_headings(lines, ["report_id"], ["page_number", "line_no"], places=["the", "and"], keywords=["introduction", "results", "literature"], provinces=["utr", "lb", "gld"])
    out = sc.section_chunks(marked, ["report_id"], ["page_number", "line_no"], "page")
    return out.select("report_id", "section_no", "section_title", "site_name", "chunk_no", "text_offset_start", sc.page_at(F.col("page_breaks"), F.lit(600)).alias("page_at_600"), F.size("page_breaks").alias("n_breaks"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[\x{0}-\x{24F}\x{1E00}-\x{1EFF}\x{2000}-\x{206F}\x{20A0}-\x{20CF}\x{2100}-\x{214F}\x{FB00}-\x{FB06}]', '', 'g')) * 1000.0 / length(text) AS density FROM documents WHERE length(text) > 0""")
def corruption_density(t: Tables) -> DataFrame:
    return t.documents.where(F.length("text") > 0).select("doc_id", tx.corruption_density(F.col("text")).alias("density"))


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS code,
  sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS offset_before
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def site_code_ffill(t: Tables) -> DataFrame:
    filled = sc.forward_fill(t.events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "code")
    earlier = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return filled.select("user_id", "event_id", "code", F.sum("value").over(earlier).alias("offset_before"))


@query("""WITH b AS (SELECT user_id, ts AS b_ts, min(event_id) AS page FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT e.event_id, b.page FROM events e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts >= b.b_ts""")
def page_asof(t: Tables) -> DataFrame:
    """As of: the last break at or before each event, by one pass over the union of both."""
    breaks = t.events.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.min("event_id").alias("page"))
    both = t.events.select("user_id", "ts", "event_id", F.lit(None).cast("long").alias("page")).unionByName(breaks.withColumn("event_id", F.lit(None).cast("long")))
    side = F.col("event_id").isNotNull().alias("side")
    return sc.forward_fill(both.withColumn("side", side), ["user_id"], ["ts", "side"], F.col("page"), "page").where("side").select("event_id", "page")


@query("""SELECT source AS report_id, count(*) AS pages, count(*) FILTER (length(trim(coalesce(text, ''), ' ')) < 10) AS n_empty, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY source""")
def ocr_routing(t: Tables) -> DataFrame:
    routed = pg.route_to_ocr(reports(t))
    return routed.groupBy("report_id").agg(F.count("*").alias("pages"), F.count_if(F.col("ocr_reason") == "empty").alias("n_empty"), F.sum(F.length("text")).alias("n_chars"))


@query()
def page_windows(t: Tables) -> DataFrame:
    return sc.pack_pages(reports(t), budget=60_000)
