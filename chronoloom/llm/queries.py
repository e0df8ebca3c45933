"""The registered queries of this folder, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embedding_dedup, language_id, line_dedup, near_dedup, secret_scan, token_count, url_filter, warc

RULES = [
    url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_documents(docs, ranks).drop("text")
    decoded = bpe.decode_documents(encoded, ranks)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archive_and_read(table(spark, sf_dir, "pages"), least_bytes=0, payloads=False)
    refers = F.regexp_extract("response.refers_to", "^urn:page:(-?[0-9]+)$", 1)
    return captures.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.when(F.col("response.type") == "revisit", refers.cast("long")).alias("refers_to"),
    )


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT page_id, html, h, min(page_id) OVER (PARTITION BY h) AS origin FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> ((3 - i % 4) * 5)::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM f"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return leaks.select("doc_id", "leak.item_id", "leak.overlap", "leak.question", "leak.answer")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) > 4)),
m AS (SELECT doc_id, item_id, count(*) / any_value(n) AS overlap FROM s JOIN i USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / any_value(n) >= 0.8),
c AS (SELECT item_id, CASE WHEN len(w) >= 10 THEN len(w) - greatest(5, ceil(len(w) / 4)::INT) ELSE len(w) END AS cut, w FROM b),
p AS (SELECT item_id, list_distinct(w[1:cut]) AS q, list_distinct(CASE WHEN len(w) >= 10 THEN w[cut + 1:] ELSE w END) AS a FROM c),
r AS (SELECT doc_id, item_id, overlap, len(list_intersect(q, w)) / len(q) AS question, len(list_intersect(a, w)) / len(a) AS answer FROM m JOIN p USING (item_id) JOIN d USING (doc_id))
SELECT * FROM r WHERE question >= 0.8 AND answer >= 0.8"""


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.9)


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs).select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


OP7_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(range(len(lines) - 2)) AS pos, lines FROM d WHERE len(lines) >= 3),
k AS (SELECT doc_id, pos, trim(lines[pos + 1], ' ') || chr(10) || trim(lines[pos + 2], ' ') || chr(10) || trim(lines[pos + 3], ' ') AS win FROM w),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n FROM k WHERE trim(replace(win, chr(10), ''), ' ') <> ''),
c AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM r WHERE n > 1),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n_removed, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NOT NULL THEN length(coalesce(kept.text, '')) END::BIGINT AS n_chars,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS text_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, vocabulary("byte_bpe_50k.json"), limit=1024).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secret_scan.BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(secret_scan.joined_spans(F.filter("spans", lambda s: s["kind"].isin(base))), 256)
    return found.select("doc_id", *map(count, base), digest.alias("base_sha256"), secret_scan.joined_spans(F.col("spans")).alias("spans"))


def _secret_sql() -> str:
    """Matches and the gaps between them, with running sums of their lengths."""
    parts = []
    for k, rule in enumerate(secret_scan.BASE_RULES + secret_scan.MORE_RULES):
        regex = rule.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, {rule.least} AS least,
  list_transform(regexp_extract_all(text, '{regex}', 0), lambda x: length(x)) AS found,
  list_transform(regexp_extract_all(text, '{regex}', {rule.group}), lambda x: length(x)) AS size,
  list_transform(regexp_split_to_array(text, '{regex}'), lambda x: length(x)) AS gap FROM d WHERE regexp_matches(text, '{regex}')""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT doc_id, k, kind, least, found, size, gap, unnest(range(1, len(found) + 1)) AS i FROM m),
s AS (SELECT doc_id, k, kind, (list_sum(gap[1:i]) + list_sum(found[1:i]) - found[i])::BIGINT AS a, (list_sum(gap[1:i]) + list_sum(found[1:i]))::BIGINT AS b FROM e WHERE size[i] >= least),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k <= 2) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe, "op2_warc": op2_warc, "op3_decontaminate": op3_decontaminate, "op4_near_dedup": op4_near_dedup,
    "op5_embedding_dedup": op5_embedding_dedup, "op6_language_id": op6_language_id, "op7_line_dedup": op7_line_dedup,
    "op8_url_filter": op8_url_filter, "op9_token_counts": op9_token_counts, "op10_secrets": op10_secrets,
}
SQL = {"op2_warc": OP2_SQL, "op3_decontaminate": OP3_SQL, "op5_embedding_dedup": OP5_SQL, "op7_line_dedup": OP7_SQL, "op10_secrets": _secret_sql()}
