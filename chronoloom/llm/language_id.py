"""Language identification by cross-parsing.

A suffix automaton is built of some labelled text per language. A text is parsed
greedily, from its first to its last character, into the longest phrases that occur in the
automaton's text; a language whose text resembles it needs few. A phrase is charged what
writing it down takes: its place in the training text of n characters, log2(n) bits, and its
length, LENGTH_BITS; an unknown character is spelled besides, in SPELL_BITS. So a language of
which little was learned pays for what it lacks. The sum over the length estimates the cross
entropy in bits per character, and the language with the least wins.

Texts are lower-cased words with one space before, between and behind them. Texts of any
length are parsed whole, in time in proportion to the length and with memory for one text.
Every label is learned; more than LANGUAGES of them are learned and asked in several blocks.

``und`` is predicted, with score 0, for null texts, texts without a letter, and where
nothing was learned. Ties go to the language that sorts first. Only the text decides:
rows with equal texts get equal predictions. Output columns replace input columns of
the same name; others pass through, whatever they are called.
"""

from __future__ import annotations

import math
import uuid

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..shared import materialise
from .pieces import bound_batches, resident

#: The sample that is learned from, by default: so many documents of a language, chosen by
#: hash, so many characters of each, and so many characters of a language at most.
SAMPLE_DOCS, DOC_CHARS, LANG_CHARS = 64, 2_000, 20_000
#: About so many languages are asked at once; a worker holds some 10 MB for each of them.
LANGUAGES = 24
#: Bits for the length of a phrase, up to 16 characters, and for a character out of all of Unicode.
LENGTH_BITS, SPELL_BITS = 4.0, math.log2(0x110000)
_words = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def words_of(text: str | None) -> list[str]:
    return _words((text or "").lower())


def plain(text: str | None) -> str:
    """The words with spaces around them; empty without a letter."""
    words = words_of(text)
    return f" {' '.join(words)} " if words else ""


class SuffixAutomaton:
    """The smallest automaton that accepts all substrings of a text."""

    def __init__(self, text: str):
        self.size = len(text)
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new, p = len(self.next), last
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] != length[p] + 1:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
                else:
                    link[new] = q
            last = new

    def phrases(self, text: str) -> int:
        """How many longest matches cover ``text``; an unknown character is a phrase of its own."""
        return self.parse(text)[0]

    def parse(self, text: str) -> tuple[int, int]:
        """The phrases that cover ``text``, and how many of them are unknown characters."""
        return Parser(self).parse(text)


class Parser:
    """An automaton as linked states: the dictionary of a state leads to those of the next ones."""

    def __init__(self, automaton: SuffixAutomaton):
        self.bits = math.log2(max(2, automaton.size)) + LENGTH_BITS
        states: list[dict] = [{} for _ in automaton.next]
        for state, following in zip(states, automaton.next):
            for c, to in following.items():
                state[c] = states[to]
        self.root = states[0]

    def parse(self, text: str) -> tuple[int, int]:
        state = root = self.root
        count = unknown = 0
        for c in text:
            to = state.get(c)
            if to is None:
                count += state is not root
                to = root.get(c)
                if to is None:
                    count += 1
                    unknown += 1
                    to = root
            state = to
        return count + (state is not root), unknown

    def rate(self, text: str) -> tuple[float, float]:
        """Bits and phrases per character of a text that is not empty."""
        phrases, unknown = self.parse(text)
        return (phrases * self.bits + unknown * SPELL_BITS) / len(text), phrases / len(text)


class Identifier:
    """One automaton per language."""

    def __init__(self, texts: dict[str, str]):
        self.parsers = [(name, Parser(SuffixAutomaton(texts[name]))) for name in sorted(texts)]

    def judge(self, text: str | None) -> tuple[str, float, float | None, float] | None:
        """The best language, its bits per character, the next best's, and the best's phrases per character."""
        letters = plain(text)
        if not letters or not self.parsers:
            return None
        rates = [(*parser.rate(letters), name) for name, parser in self.parsers]
        (bits, phrases, name), *rest = sorted(rates, key=lambda r: (r[0], r[2]))
        return name, bits, rest[0][0] if rest else None, phrases

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """The language, a score from 0 to 1, and the winner's phrases per character."""
        found = self.judge(text)
        if found is None:
            return "und", 0.0, 1.0
        name, bits, other, phrases = found
        return name, 1.0 if other is None else other / (other + bits), phrases


def remainder(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def training_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", held_out: int = 2) -> DataFrame:
    """(doc_id, lang, text) of the labelled documents outside the held-out fold."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id") != held_out))


def training_texts(rows: DataFrame, counts: dict[str, int], sample_docs: int = SAMPLE_DOCS, doc_chars: int = DOC_CHARS, lang_chars: int = LANG_CHARS) -> dict[str, str]:
    """What is learned of each language of ``counts``, which states how many of ``rows`` it has.

    ``sample_docs`` documents of a language, ``doc_chars`` characters of each and
    ``lang_chars`` of a language are taken at most.
    """
    if not counts:
        return {}
    # thinned by hash before ranking, so that the ranking's input is bounded too
    whole = 1 << 40
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(whole, whole * 40 * sample_docs // n))])
    draw = F.xxhash64("doc_id", F.lit("sample"))
    thin = rows.where(F.pmod(draw, F.lit(whole)) < F.try_element_at(share, F.col("lang"))).withColumn("draw", draw)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    chosen = thin.select("doc_id", "lang", "draw").withColumn("place", place).where(F.col("place") <= sample_docs)
    picked = thin.join(F.broadcast(chosen.select("doc_id", "lang", "place")), ["doc_id", "lang"])  # sample_docs rows of each language
    out: dict[str, str] = {}
    for row in sorted(picked.select("lang", "place", F.substring("text", 1, doc_chars).alias("text")).collect(), key=lambda r: (r.lang, r.place, r.text)):
        more = "".join(f" {w}" for w in words_of(row.text))
        out[row.lang] = (out.get(row.lang, "") + more)[:lang_chars]
    return {k: f"{v} " for k, v in out.items() if v}


def _judge(spark, texts: dict[str, str]):
    """A function on texts over the broadcast samples, which their bounds keep small."""
    shipped, token = spark.sparkContext.broadcast(texts), uuid.uuid4().hex

    @arrow_udf("struct<lang:string,bits:double,other:double,phrases:double>")
    def judge(rows: pa.Array) -> pa.Array:
        identifier = resident(("language", token), lambda: Identifier(shipped.value))
        found = [identifier.judge(row.as_py()) or (None, None, None, None) for row in rows]
        columns = zip(*found) if found else ((), (), (), ())
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.float64()))], ["lang", "bits", "other", "phrases"])

    return judge


def _with_verdict(rows: DataFrame, doc: str, found: str, names: list[str]) -> DataFrame:
    """The packed columns with lang_pred, score and phrase_rate from a struct column."""
    bits, other = F.col(f"{found}.bits"), F.col(f"{found}.other")
    score = F.when(bits.isNull(), 0.0).when(other.isNull(), 1.0).otherwise(other / (other + bits))
    new = {"lang_pred": F.coalesce(f"{found}.lang", F.lit("und")), "score": score, "phrase_rate": F.coalesce(f"{found}.phrases", F.lit(1.0))}
    old = [new.pop(c).alias(c) if c in new else F.col(f"{doc}.c{i}").alias(c) for i, c in enumerate(names)]
    return rows.select(*old, *[v.alias(k) for k, v in new.items()])


def _packed(docs: DataFrame) -> Column:
    # the caller's columns travel inside one, so that their names meet none of the operator's
    return F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("doc")


def identify(docs: DataFrame, texts: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, and phrase_rate, the winner's phrases per character."""
    bound_batches(docs.sparkSession)
    return _with_verdict(docs.select(_packed(docs), _judge(docs.sparkSession, texts)(F.col(text)).alias("found")), "doc", "found", docs.columns)


def predict_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", languages: int | None = None, **sample: int) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold, then predict every row; adds held_out.

    Up to ``languages`` labels (LANGUAGES if absent) are asked within one plan. More are asked
    in blocks, one job after the other, and the best of all blocks wins: the driver and a
    worker hold one block at a time. ``sample`` is passed to ``training_texts``.
    """
    spark, languages = docs.sparkSession, languages or LANGUAGES
    docs = docs.withColumn("held_out", F.coalesce(remainder(doc_id) == 2, F.lit(False)))
    rows = training_rows(docs, doc_id, text, lang)
    labels = materialise(rows.groupBy("lang").agg(F.count("*").alias("n")), "labels")
    blocks = -(-labels.count() // languages) or 1
    block = F.pmod(F.xxhash64("lang"), F.lit(blocks))

    def learned(number: int) -> dict[str, str]:
        some = {r.lang: r.n for r in labels.where(block == number).collect()}  # about `languages` rows
        return training_texts(rows.where(block == number), some, **sample)

    if blocks == 1:
        return identify(docs, learned(0), text)
    bound_batches(spark)
    numbered = materialise(docs.select(_packed(docs), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")), "numbered")
    found = None
    for number in range(blocks):
        part = materialise(numbered.select("row", _judge(spark, learned(number))("text").alias("f")).where("f.lang is not null"), "judged")
        found = part if found is None else found.unionByName(part)
    # the least rate wins; the next best is the least of what is left
    order = F.array_sort(F.collect_list(F.struct("f.bits", "f.lang", "f.other", "f.phrases"))).alias("all")
    ranked = found.groupBy("row").agg(order).select("row", F.col("all")[0].alias("best"), F.try_element_at("all", F.lit(2)).alias("next"))
    best = ranked.select("row", F.struct("best.lang", "best.bits", F.least("best.other", "next.bits").alias("other"), "best.phrases").alias("found"))
    return _with_verdict(numbered.join(best, "row", "left"), "doc", "found", docs.columns)
