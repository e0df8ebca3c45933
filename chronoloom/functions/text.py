"""Text cleaning and normalising as column expressions; everything stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ligatures and what they stand for.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))
#: Page furniture, as whole trimmed lines in any case.
FURNITURE = r"(?iU)^(?:page\s+\d+|archaeological report)\s*$"
#: Older Dutch era idioms and adjectives, and their modern forms.
ARCHAIC = (
    (r"(?iU)\bonze[r]?\s+jaartelling\b", "n.Chr."), (r"(?iU)\bonze[r]?\s+tijdrekening\b", "n.Chr."),
    (r"(?iU)\bna\s+Christus\b", "n.Chr."), (r"(?iU)\bna\s+Chr\.", "n.Chr."),
    (r"(?iU)\bv[oó]{1,2}r\s+Christus\b", "v.Chr."), (r"(?iU)\bv[oó]{1,2}r\s+Chr\.", "v.Chr."),
    (r"(?iU)\bRomeinschen\b", "Romeinse"), (r"(?iU)\bRomaanschen\b", "Romaanse"), (r"(?iU)\bGermaanschen\b", "Germaanse"),
    (r"(?iU)(?<!i)sche\b", "se"), (r"(?iU)(?<!i)sch\b", "s"),
)


def swap(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Apply (pattern, replacement) rules in order."""
    return reduce(lambda t, rule: F.regexp_replace(t, F.lit(rule[0]), F.lit(rule[1])), rules, text)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def blank_to_null(text: Column) -> Column:
    """Missing is null inside the engine; empty strings exist at file borders only."""
    return F.when(F.trim(text) != "", text)


def unfold_ligatures(text: Column) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), LIGATURES, text)


def is_fragmented(text: Column) -> Column:
    """At least 20 lines with text, more than a fifth of which are single letters."""
    filled = F.filter(F.transform(lines_of(text), lambda x: F.trim(x)), lambda line: line != "")
    single = F.filter(filled, lambda line: line.rlike(r"^\p{L}$"))
    return (F.size(filled) >= 20) & (F.size(single) > 0.2 * F.size(filled))


def join_fragments(text: Column) -> Column:
    """Runs of one-character lines become one line; other lines stay.

    A line end between two one-character lines is what goes, which is a property of its
    neighbourhood: no fold over the lines is needed.
    """
    stripped = F.regexp_replace(text, r"(?m)^[ \t]+(?=[\p{L}\p{N}][ \t]*$)|(?m)(?<=^[\p{L}\p{N}])[ \t]+$", "")
    return F.regexp_replace(stripped, r"(?<=(?:^|\n)[\p{L}\p{N}]|(?<=[\p{L}\p{N}])\n[\p{L}\p{N}])\n(?=[\p{L}\p{N}](?:\n|$))", "")


def defragment(text: Column) -> Column:
    return F.when(is_fragmented(text), join_fragments(text)).otherwise(text)


#: C3 to C6: control characters and Syriac blocks, a stray b between glued words, spaces,
#: hyphens at line ends, Dutch diminutives, and two ware spellings.
_EARLY = (
    (r"[\x01-\x08\x0b\x0c\x0e-\x1f]", " "), (r"[܀-ݿ]", " "),
    (r"(?<=[a-zA-Z])b(?=[A-Z0-9])", " "), (r"(?<=\d)b(?=[A-Z])", " "), (r"(?<=\d)b(?=[a-z]{2,})", " "),
    (r"[\t\f\x0B]+", " "), (r" {2,}", " "),
    (r"(?U)(\w)-\n([a-z])", "$1-$2"), (r"(?U)(\w)-((?:tje|je|pje|kje|etje)s?)\b", "$1$2"),
    (r"(?iU)\bterra-(sigillata|nigra|rubra)\b", "terra $1"), (r"(?U)\bDrag\s+(\d)", "Drag. $1"),
)
#: C8: dashes, points, commas and runs of white space.
_LATE = (
    (r"[–—]", "-"), (r"(?U)\s+\.", "."), (r"([a-z]{2,})\. ?([A-Z])", "$1. $2"), (r"(?U)\s*,\s*", ", "), (r"(?U)\s{2,}", " "),
)


def drop_furniture(text: Column) -> Column:
    """Trim the lines, drop page furniture, and leave no more than one blank line in a row."""
    trimmed = F.transform(lines_of(text), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    kept = F.array_join(F.filter(trimmed, lambda line: ~line.rlike(FURNITURE)), "\n")
    return F.regexp_replace(kept, r"\n{3,}", "\n\n")


def clean_text(text: Column) -> Column:
    """C1 to C8 in their fixed order; null and empty give the empty string."""
    text = unfold_ligatures(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("\n")))
    text = swap(defragment(text), _EARLY)
    return F.regexp_replace(swap(drop_furniture(text), _LATE), r"(?U)^\s+|\s+$", "")


def clean_text_plain(text: Column) -> Column:
    """C5, C7 and C8 in ASCII classes only, as an engine without lookaround can state them."""
    text = swap(F.coalesce(text, F.lit("")), ((r"[\t\f]+", " "), (r" {2,}", " ")))
    kept = F.filter(F.transform(lines_of(text), lambda x: F.trim(x)), lambda line: ~F.lower(line).rlike(r"^page +[0-9]+$"))
    rules = ((r"\n{3,}", "\n\n"), (r"[–—]", "-"), (r"[ \n]+\.", "."), (r"[ \n]*,[ \n]*", ", "), (r"[ \n]{2,}", " "))
    return F.trim(swap(F.array_join(kept, "\n"), rules))


def modern_spelling(text: Column) -> Column:
    return swap(text, ARCHAIC)


def corruption_density(text: Column) -> Column:
    """Glyphs outside Latin text, punctuation and symbols, per thousand characters."""
    odd = F.regexp_count(text, F.lit(r"[^\x00-ɏḀ-ỿ -⁯₠-⃏℀-⅏ﬀ-ﬆ]"))
    return F.when(F.length(text) > 0, odd * 1000.0 / F.length(text)).otherwise(0.0)


def needs_ocr(text: Column, least: int = 10, density: float = 0.5, glyphs: int = 3) -> Column:
    """Why a page is read again: ``empty``, ``corrupt`` (the old layer is kept), or null."""
    count = F.round(corruption_density(text) * F.length(text) / 1000)
    return (F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < least, "empty")
            .when((corruption_density(text) >= density) & (count >= glyphs), "corrupt"))


def surface_form(term: Column) -> Column:
    """Lower case, one spelling of the common series name, and letters, digits, spaces, hyphens only."""
    term = swap(F.lower(F.trim(term)), ((r"\bdrag(?:endorff|\.)?(?=[\s\d.]|$)\.?", "dragendorff"),))
    return F.trim(swap(term, ((r"[^a-z0-9\s-]", ""), (r"\s+", " "))))


def canonical_code(code: Column) -> Column:
    """``Drag. 37`` and ``drag_37`` are DRAG_37."""
    return F.upper(F.btrim(F.regexp_replace(code, r"[^A-Za-z0-9]+", "_"), F.lit("_")))


def only_alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]", "")


def spaced_alnum(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


#: Abbreviations of typology series.
SERIES = (
    (r"^drag\.?\s*(?=\d)", "dragendorff "), (r"^dr\.?\s*(?=\d)", "dressel "), (r"^nb\.?\s*(?=\d)", "niederbieber "),
    (r"^ha\.?\s*(?=\d)", "haltern "), (r"^hofh\.?\s*(?=\d)", "hofheim "), (r"^ludowici\s*|^lud\.?\s*(?=[a-z]?\d)", "ludowici "),
)


def typology_form(typology: Column) -> Column:
    """A comparable typology: series names in full, no hedges, no ``type`` or ``vorm``."""
    text = F.trim(F.lower(F.coalesce(typology, F.lit(""))))
    text = swap(text, ((r"\b(?:cf|vgl|ca|mogelijk|possibly|probably)\b\.?|\?", " "), (r"\b(?:type|vorm|form)\b\.?", " "), (r"\s+", " ")))
    text = swap(F.trim(text), SERIES)
    return F.trim(swap(text, ((r"\s*/\s*", "/"), (r"[^a-z0-9/ ]", " "), (r"\s+", " "))))


def tokens(text: Column, stop: tuple[str, ...] = (), aliases: dict[str, str] | None = None, least: int = 3) -> Column:
    """Distinct lower-cased words of ``least`` letters, aliased, singular, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}0-9]+"), F.lit(0))
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        words = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))
    words = F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.left(w, F.length(w) - 1)).otherwise(w))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(list(stop) or [""])))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def registration_number(text: Column) -> Column:
    """The first run of three or more number segments that holds a slash, without leading ``-`` and ``/``."""
    found = F.regexp_extract_all(text, F.lit(r"[-/]*\d+(?:[-/]+\d+){2,}"), F.lit(0))
    with_slash = F.filter(found, lambda x: F.ltrim(x, F.lit("-/")).contains("/"))
    return F.ltrim(F.get(with_slash, 0), F.lit("-/"))


def is_tabular(text: Column, headers: tuple[str, ...], share: float = 0.3, least: int = 5) -> Column:
    """Two distinct header words, or a large share of lines that are mostly figures."""
    lines = F.filter(F.transform(lines_of(text), lambda x: F.trim(x)), lambda line: line != "")
    numeric = F.filter(lines, lambda line: line.rlike(r"^[\d\s.,/%-]+$"))
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b(" + "|".join(headers) + r")\b"), F.lit(1)))
    return (F.size(found) >= 2) | ((F.size(lines) >= least) & (F.size(numeric) >= share * F.size(lines)))
