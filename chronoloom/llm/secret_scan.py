"""Secret scanning through a trigram inverted index, with DataFrame functions only.

Every rule's expression gives a Boolean trigram query. The index holds a posting
(trigram, row) for each trigram that some query names; there may be any number of them.
Intersecting a row's postings tells which rules can match it; only the texts of such
candidates are read again, and only those rules are run on them. Rules whose query is
empty run on every text in the scan that makes the postings, so no text is moved for them.

Null texts hold nothing. Texts may be of any length: matching neither recurses nor takes
quadratic time, and a text is held whole by one row at a time. Rows with equal ids and
texts are scanned alike; an empty table gives an empty result. Columns of the input other
than the id are not returned, whatever they are called.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise
from .trigrams import trigram_query, trigrams_of


class Rule(NamedTuple):
    """A kind of secret: a Java regular expression, and how long its ``group`` must be."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The expressions and lengths of the three base kinds. A run of fewer
#: than the least number of characters fails, so hex and access state the length inside.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Further kinds with published token formats. No expression repeats a group without a
#: bound, and what may fail after a long run has a bounded run: the header of a key has at
#: most four words before ``PRIVATE KEY``, the header of a web token at most 503 characters.
#: So a rule takes time in proportion to the text, whatever the text holds.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]{1,16} ){0,4}PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,500}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


#: Trigrams whose postings meet in one long.
WORD = 63
#: The matches of one rule in a text.
FOUND = "struct<rule:int,parts:array<struct<gap:int,len:int,size:int>>>"


def _holds(query, numbers: dict[str, int]) -> Column:
    if isinstance(query, str):
        word, bit = divmod(numbers[query], WORD)
        return F.getbit(f"bits{word}", F.lit(bit)) == 1
    parts = [_holds(q, numbers) for q in query[1]]
    out = parts[0]
    for part in parts[1:]:
        out = out & part if query[0] == "and" else out | part
    return out


def _found(number: int, rule: Rule, text: str) -> Column:
    """All matches of a rule: the gap before each, its length and the length of its group; null without any."""
    pattern = F.lit(rule.pattern)
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    size = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    parts = F.struct(F.lit(number).alias("rule"), F.arrays_zip(gaps.alias("gap"), found.alias("len"), size.alias("size")).alias("parts"))
    return F.when(F.rlike(text, pattern), parts)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and ``spans``, an array of (kind, start, end).

    Offsets count code points, ``end`` is exclusive; spans stand by start, then in the
    order of the rules. Of each kind the matches are leftmost and do not overlap.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted(set().union(*map(trigrams_of, queries)))
    numbers = {t: i for i, t in enumerate(trigrams)}
    asking = [i for i, q in enumerate(queries) if q is not None]
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = keyed.withColumn("digest", F.unhex(F.md5("text")))
    # one scan of the texts: postings, and the matches of rules that every text must be scanned for
    low = keyed.withColumn("low", F.lower("text"))
    held = F.array_compact(F.array(F.lit(None).cast("int"), *[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    full = F.array_compact(F.array(F.lit(None).cast(FOUND), *[_found(i, r, "text") for i, r in enumerate(rules) if queries[i] is None]))
    # numbered once, when written: from here on a row is known by its number
    rows = materialise(low.select("doc_id", "digest", F.monotonically_increasing_id().alias("row"), held.alias("trigrams"), full.alias("found")), "secrets")
    if asking:
        words = [F.bit_or(F.when(F.floor(F.col("trigram") / WORD) == w, F.expr(f"shiftleft(1L, trigram % {WORD})")).otherwise(F.lit(0).cast("long"))).alias(f"bits{w}") for w in range(-(-len(trigrams) // WORD))]
        postings = rows.select("row", F.explode("trigrams").alias("trigram"))
        # a row's postings meet, combined before the shuffle; rows that no rule can match go
        candidates = postings.groupBy("row").agg(*words).select("row", F.array_compact(F.array(*[F.when(_holds(queries[i], numbers), F.lit(i)) for i in asking])).alias("asks")).where(F.size("asks") > 0)
        asked = materialise(rows.select("row", "doc_id", "digest").join(candidates, "row"), "candidates")
        # only candidates are verified; a written table tells the planner whether it may be broadcast
        wanted = asked.groupBy("doc_id", "digest").agg(F.max("asks").alias("asks"))
        wanted = materialise(wanted, "wanted").select(F.col("doc_id").alias("id"), F.col("digest").alias("of"), "asks")
        texts = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")))
        checked = F.array_compact(F.array(*[F.when(F.array_contains("asks", F.lit(i)), _found(i, rules[i], "text")) for i in asking]))
        verified = texts.select("id", "of", checked.alias("matches")).where(F.size("matches") > 0)
        # rows with equal ids and texts find the same; small rows meet their finds
        verified = verified.groupBy("id", "of").agg(F.max("matches").alias("found"))
        verified = asked.join(verified, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of"))).select("row", "found")
        parts = rows.where(F.size("found") > 0).select("row", "found").unionByName(verified)
    else:
        parts = rows.where(F.size("found") > 0).select("row", "found")
    parts = (parts.select("row", F.explode("found").alias("f")).select("row", "f.rule", F.posexplode("f.parts").alias("at", "part")))
    upto = Window.partitionBy("row", "rule").orderBy("at")
    spans = parts.select("row", "rule", "part.size", "part.len", F.sum(F.col("part.gap") + F.coalesce(F.col("part.len"), F.lit(0))).over(upto).alias("end"))
    least = F.array(*[F.lit(r.least) for r in rules])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = (spans.where(F.col("len").isNotNull() & (F.col("size") >= F.element_at(least, F.col("rule") + 1)))
             .groupBy("row").agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("len")).alias("start"), "rule", "end"))).alias("s")))
    spans = spans.select("row", F.transform("s", lambda s: F.struct(F.element_at(kinds, s["rule"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)")
    return rows.select("doc_id", "row").join(spans, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
