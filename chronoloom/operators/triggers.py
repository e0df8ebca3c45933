"""Mentions found by trigger words: what they name, and whether that is a find.

The lexicon is a parameter. Each trigger is named from its own sentence: by the first naming
expression that spans it, as a bare vessel or a generic token alone on its line, by the
trigger itself without a glued-on tail, or as a member of an enumeration.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sections import CATEGORY, SENTENCE_END, SITE_CODE, category_block, clause_after, is_table_cell, page_at, sentence_or_line, sentences_around, site_code_before
from .spans import alternation, first_by_position, matches_of, not_covered


class Lexicon(NamedTuple):
    """Expressions and word lists of a domain; Java regular expressions, case folded where marked."""

    triggers: tuple[str, ...]
    naming: tuple[str, ...]
    vessels: tuple[str, ...]
    indicator: str
    tail: str = r"(?:fragment(?:en)?|scherf|scherven|stuk(?:ken)?|rest(?:en)?|materiaal)"
    generic: tuple[str, ...] = ("pottery", "sherds", "sherd", "ceramics", "vessel", "ware", "wares", "type")
    tokens: tuple[str, ...] = ("pot", "beker", "onbekend", "indet", "unknown")
    indeterminate: tuple[str, ...] = ("onbekend", "indet", "unknown")
    headers: tuple[str, ...] = ("function", "category", "fragments", "tableware", "storage")
    materials: str = r"(?i)\b(?:bronze|iron|glass|stone|wood|bone)\b"
    ware_group: str = r"(?i)^(?:(?:early|middle|late)\s+)*(?:roman|medieval|prehistoric)\s+(?:coarse|fine|rough|grey|common)\s+wares?$"
    vessel_of_ware: str = r"(?i)^(\p{L}+)\s+(?:van|of)\s+(?:[\w-]+\s+){0,4}(?:terra\s+sigillata|aardewerk|pottery)\b"


def is_valid_name(name: Column, lexicon: Lexicon) -> Column:
    """Six reasons to reject a name, and one thing it must have."""
    n = F.trim(name)
    bad = n.rlike(r"^\d+$") | n.startswith("[") | n.endswith("]") | F.lower(n).isin(*lexicon.generic) | n.rlike(lexicon.ware_group) | n.rlike(lexicon.materials)
    return F.coalesce(~bad & n.rlike(lexicon.indicator), F.lit(False))


def first_name(sentence: Column, lexicon: Lexicon) -> Column:
    """The first valid match of a naming expression anywhere in a sentence."""
    found = [F.nullif(F.regexp_extract(sentence, p, 0), F.lit("")) for p in lexicon.naming]
    return F.coalesce(*[F.when(is_valid_name(f, lexicon), F.trim(f)) for f in found])


def name_at(sentence: Column, start: Column, end: Column, term: Column, lexicon: Lexicon) -> Column:
    """What the trigger at a place in its sentence names, or null."""
    def spanning(pattern: str) -> Column:
        inside = F.filter(matches_of(sentence, pattern), lambda m: (m["start"] <= start) & (m["end"] >= end) & is_valid_name(m["term"], lexicon))
        return F.trim(F.get(inside, 0)["term"])

    vessel = r"(?i)^(?:[a-z]+\s+)?(?:" + "|".join(lexicon.vessels) + r")s?$"
    whole = F.trim(sentence)
    token = F.trim(F.regexp_replace(whole, r"\?+$", ""))
    bare = F.trim(F.regexp_replace(F.trim(term), r"(?i)" + lexicon.tail + "$", ""))
    listed = F.left(sentence, start).rlike(r"(?:,|\band\b|\ben\b|&)\s*$") & F.trim(term).rlike(vessel) & sentence.rlike(lexicon.indicator)
    return F.coalesce(
        *map(spanning, lexicon.naming), F.when(whole.rlike(vessel), F.concat(F.upper(F.left(whole, F.lit(1))), F.lower(F.substring(whole, 2, 1 << 20)))),
        F.when(F.lower(token).isin(*lexicon.tokens), token), F.when(is_valid_name(bare, lexicon), bare), F.when(listed, F.trim(term)),
    )


def is_header_cell(name: Column, before: Column, after: Column, lexicon: Lexicon) -> Column:
    """A bare form beside a column header of a cross table is a header itself."""
    form = F.lower(name).rlike(r"^(?:" + "|".join(lexicon.vessels) + r")s?$") | F.lower(name).isin(*lexicon.tokens)
    beside = lambda c: F.coalesce(F.lower(F.trim(c)).isin(*lexicon.headers), F.lit(False))
    return form & (beside(before) | beside(after))


def is_column_fill(name: Column, around: Column, lexicon: Lexicon) -> Column:
    """An indeterminate word that repeats itself at once fills a column."""
    word = F.lower(F.trim(name))
    doubled = F.coalesce(*[F.when(word == w, F.lower(around).rlike(rf"{w}\W+{w}")) for w in lexicon.indeterminate], F.lit(False))
    return doubled


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once.

    A generator stands between them and what uses them, so the optimizer does not copy
    their expressions into every later filter and projection.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_contexts(found: DataFrame, text: str, site_at: Column) -> DataFrame:
    """``found`` with the contexts of ``mentions``; needs the columns that it has read by then."""
    begin = F.col("start") - F.col("_begin")
    # a sentence's own point lies behind it and its own beginning counts as the first end before it
    near = sentences_around(F.col(text), begin, begin + F.length("_s") + 1, 2, 2, F.col("_bounds"))
    line = F.trim("context_line")
    short = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) <= 12
    contexts = {
        "clause_date_context": F.trim(clause_after(F.substring(F.col("_s"), F.col("_begin") + 1, F.length("_s")))),
        "line_date_context": F.when((F.length(line) <= 60) & (short("_prev") | short("_next")), line).otherwise(""),
        "date_context": F.when(F.col("is_full_section"), category_block(F.col(text), F.col("start"), F.col("_labels"))).otherwise(near) if "is_full_section" in found.columns else near,
        "forward_date_context": sentences_around(F.col(text), F.col("start"), F.col("start"), 0, 4, F.col("_bounds"), 650),
        "site_code": F.coalesce(site_code_before(F.lit(""), site_at, F.col("_codes")), F.lit("")),
    }
    if "page_breaks" in found.columns:
        contexts["page"] = page_at(F.col("page_breaks"), begin)
    return found.withColumns(contexts)


def mentions(chunks: DataFrame, lexicon: Lexicon, known: DataFrame | None = None, keys: tuple[str, ...] = ("report_id", "section_no"), text: str = "chunk_text") -> DataFrame:
    """Named mentions outside the spans of ``known``, once per place in the section.

    ``chunks`` has the keys, chunk_no, text_offset_start and the text. Adds start, end, term,
    name, sentence and context_line. A vessel made of a ware claims the ware behind it. Then
    the contexts in which a mention's date and site are looked for: clause_date_context (up to
    the next comma or point), line_date_context (the own cell of a table), date_context (the own
    category of an entry, if chunks have is_full_section and it is true, else with one sentence
    before and two after), forward_date_context (four sentences on, 650 characters at least), site_code
    (the inventory code above, in section_text if there is one), and page by page_breaks.
    """
    group = [*keys, "chunk_no"]
    words = alternation(list(lexicon.triggers), lexicon.tail + "?")
    whole = F.col("section_text") if "section_text" in chunks.columns else F.col(text)
    # read off a chunk once, not once for every mention
    places = {"_bounds": matches_of(F.col(text), SENTENCE_END), "_labels": matches_of(F.col(text), CATEGORY), "_codes": matches_of(whole, SITE_CODE)}
    found = chunks.where(F.rlike(F.col(text), F.lit(words))).withColumns(places).select("*", F.inline(matches_of(F.col(text), words)))
    if known is not None:
        found = not_covered(found, known, group)
    head, rest = F.left(F.col(text), F.col("start")), F.substring(F.col(text), F.col("start") + 1, F.length(text))
    claim = F.length(F.regexp_extract(rest, lexicon.vessel_of_ware, 0))
    found = found.withColumn("_claim", F.when(F.lower("term").isin(*lexicon.vessels), claim).otherwise(0))
    reach = F.max(F.when(F.col("_claim") > 0, F.col("start") + F.col("_claim"))).over(Window.partitionBy(*group).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("_reach", reach).where(F.coalesce(F.col("_reach") < F.col("end"), F.lit(True)))
    before = F.regexp_extract(head, r"(?s)^(?:.*(?<![A-Z\d])\.[ \t\r\n]+(?=[A-Z(]))?(.*)$", 1)
    after = F.regexp_extract(rest, r"(?s)^(.*?)(?:(?<![A-Z\d])\.[ \t\r\n]+(?=[A-Z(])|$)", 1)
    line_head, line_rest = F.substring_index(head, "\n", -1), F.split_part(rest, F.lit("\n"), F.lit(1))
    lines = F.split(F.col(text), "\n", -1)
    at = F.size(F.split(head, "\n", -1))
    found = settled(found, _before=before, _line_before=line_head, sentence=F.concat(before, after), context_line=F.concat(line_head, line_rest), _prev=F.get(lines, at - 2), _next=F.get(lines, at))
    cell = is_table_cell(F.col("context_line"), F.col("_prev"), F.col("_next"))
    own_line = cell | (F.length("sentence") > 300)
    begin = F.when(own_line, F.length("_line_before")).otherwise(F.length("_before"))
    found = settled(found, _s=F.when(own_line, F.col("context_line")).otherwise(sentence_or_line(F.col("sentence"), F.col("context_line"))), _begin=begin)
    name = name_at(F.col("_s"), F.col("_begin"), F.col("_begin") + F.length("term"), F.col("term"), lexicon)
    named = settled(found, name=F.when(F.col("_claim") > 0, F.initcap("term")).otherwise(name))
    near = F.substring(F.col(text), F.greatest(F.lit(1), F.col("start") - 39), F.lit(80))
    named = named.where(F.col("name").isNotNull() & ~is_header_cell(F.col("name"), F.col("_prev"), F.col("_next"), lexicon) & ~is_column_fill(F.col("name"), near, lexicon))
    named = named.withColumn("abs_start", F.col("text_offset_start") + F.col("start"))
    named = with_contexts(named, text, F.col("abs_start") if "section_text" in chunks.columns else F.col("start"))
    named = first_by_position(named, [*keys, "abs_start"], ["chunk_no"])
    return named.drop(*[c for c in named.columns if c.startswith("_")])
