"""Years and year ranges. A year is a signed integer, negative before our era; there is no year 0."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

OPEN = 10**9
#: The scope window and the clamp window of the reports' period.
SCOPE, CLAMP = (-52, 450), (-12, 450)
RANGE = "struct<start:int,end:int>"


def year_range(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def century_range(n: Column, part: Column, before: Column) -> Column:
    """(start, end) of a century; ``part`` is early, mid, late or null.

    Early is the first 51 years and late starts at the 51st; mid is the middle half, and the
    whole century before our era.
    """
    start = F.when(before, -n * 100).otherwise((n - 1) * 100 + 1)
    end = F.when(before, -(n - 1) * 100 - 1).otherwise(n * 100)
    mid = (part == "mid") & ~before
    low = F.when(part == "late", start + 50).when(mid, start + 25).otherwise(start)
    high = F.when(part == "early", start + 50).when(mid, end - 25).otherwise(end)
    return year_range(low, high)


def parse_year(text: Column) -> Column:
    """The first integer of a text, negative if a marker of the time before our era follows."""
    digits = F.regexp_extract(text, r"-?\d+", 0)
    before = F.lower(text).rlike(r"(^|[^a-z])(bce?|v\. ?chr\.?)($|[^a-z])")
    year = digits.try_cast("int")
    return F.when(before & (year > 0), -year).otherwise(year)


def format_year(year: Column) -> Column:
    return F.when(year < 0, F.concat((-year).cast("string"), F.lit(" BC"))).otherwise(F.concat(F.lit("AD "), year.cast("string")))


def format_range(start: Column, end: Column) -> Column:
    return F.when(start == end, format_year(start)).otherwise(F.concat_ws(" - ", format_year(start), format_year(end)))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Closed ranges share a year."""
    return (s1 <= e2) & (s2 <= e1)


def in_scope(start: Column, end: Column, window: tuple[int, int] = SCOPE) -> Column:
    """Undated, or a positive width inside the window; a missing end is open."""
    undated = start.isNull() & end.isNull()
    return undated | ((F.coalesce(start, F.lit(-OPEN)) < window[1]) & (F.coalesce(end, F.lit(OPEN)) > window[0]))


def clamp_one_sided(start: Column, end: Column, window: tuple[int, int] = CLAMP) -> Column:
    """A range with one end missing takes the window's end, if that leaves a range."""
    low = F.when(start.isNull() & end.isNotNull() & (end >= window[0]), F.lit(window[0])).otherwise(start)
    high = F.when(end.isNull() & start.isNotNull() & (start <= window[1]), F.lit(window[1])).otherwise(end)
    return year_range(low, high)


#: Numbered and spelt ordinals of both languages.
ORDINALS_EN = {"1st": 1, "2nd": 2, "3rd": 3, "4th": 4, "5th": 5, "6th": 6, "7th": 7, "8th": 8, "9th": 9, "10th": 10}
WORDS_EN = ("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth "
            "fifteenth sixteenth seventeenth eighteenth nineteenth twentieth twenty-first").split()
WORDS_NL = "eerste tweede derde vierde vijfde zesde zevende achtste negende tiende".split()
#: Parts of a century, and the ranges of qualified period names.
PARTS = {"early": "early", "vroeg": "early", "vroege": "early", "mid": "mid", "middle": "mid", "midden": "mid", "late": "late", "laat": "late"}
PERIODS = {"early": (-12, 70), "mid": (71, 275), "late": (276, 450)}

SIGNAL = StructType([StructField("expression", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
                     StructField("date_type", StringType()), StructField("precision", StringType())])


def _either(words) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


class SignalGrammar:
    """Date expressions as one list of productions in order of precedence.

    A production is an expression with named groups and a way to read a match; a stretch of
    text belongs to the first production that claims it.
    """

    def __init__(self, periods: dict[str, tuple[int, int]] = PERIODS):
        nl_numbers = {f"{n}{suffix}": n for n in range(1, 22) for suffix in ("e", "de", "ste")}
        self.numbers = ORDINALS_EN | nl_numbers | {w: i for i, w in enumerate(WORDS_EN, 1)} | {w: i for i, w in enumerate(WORDS_NL, 1)}
        self.periods = periods
        en, en_word, nl, nl_word = map(_either, (ORDINALS_EN, WORDS_EN, nl_numbers, WORDS_NL))
        en_era, nl_era = r"(?:\s*(?P<era>BCE|BC|AD|CE))?\b", r"(?:\s*(?P<era>n\.Chr\.|v\.Chr\.))?(?!\w)"
        dash = r"\s*[-–—]\s*"
        en_and, nl_and = rf"(?:{dash}|\s+(?:and|to|through)\s+)", rf"(?:{dash}|\s+en\s+|\s+tot(?:\s+de)?\s+|\s*,?\s*(?:wellicht|mogelijk|misschien|vermoedelijk|of)\s+)"
        en_part, nl_part = r"(?:\b(?P<part>early|middle|mid|late))?\s*", r"(?:\b(?P<part>vroeg|midden|laat))?\s*-?\s*"
        year = r"(?P<a>\d{1,4})(?:" + dash + r"(?P<b>\d{1,4}))?"
        self.productions = [(re.compile(p, re.IGNORECASE), read) for p, read in (
            (rf"{nl_part}\b(?P<n>{nl})\s*-\s*eeuws?e?\b", self._century),
            (rf"\b(?P<part>midden)\s+van\s+de\s+(?P<n>{nl})\s+eeuw\b", self._century),
            (rf"\b(?P<n>{en}){en_and}(?P<m>{en})\s+centur(?:y|ies){en_era}", self._centuries),
            (rf"\b(?P<n>{en_word}){en_and}(?P<m>{en_word})\s+centur(?:y|ies){en_era}", self._centuries),
            (rf"\b(?P<n>{nl}){nl_and}(?P<m>{nl})\s+eeuw{nl_era}", self._centuries),
            (rf"\b(?P<era>AD|BC)\s*{year}\b", self._years),
            (rf"\b{year}\s*(?P<era>CE|BCE|BC|AD|n\.Chr\.|v\.Chr\.)(?!\w)", self._years),
            (rf"{en_part}\b(?P<n>{en})\s+centur(?:y|ies){en_era}", self._century),
            (rf"{nl_part}\b(?P<n>{nl})\s+eeuw{nl_era}", self._century),
            (rf"(?:\b(?P<part>vroege?|midden|late?|laat))?\s*-?\s*\b(?P<n>{nl_word})\s+(?P<eeuw>eeuwen|eeuw){nl_era}", self._century),
            (rf"{en_part}\b(?P<n>{en_word})\s+centur(?:y|ies){en_era}", self._century),
            (r"\b(?P<part>early|late|middle|mid|vroeg|laat|midden)\s*-?\s*(?:Roman(?:\s+period)?|Romeinse?(?:\s+periode)?)", self._period),
        )]

    @staticmethod
    def _before(match) -> bool:
        return (match.groupdict().get("era") or "").lower() in ("bc", "bce", "v.chr.")

    @staticmethod
    def _range(n: int, part: str | None, before: bool) -> tuple[int, int]:
        start, end = (-n * 100, -(n - 1) * 100 - 1) if before else ((n - 1) * 100 + 1, n * 100)
        if part == "mid" and not before:
            return start + 25, end - 25
        return (start + 50 if part == "late" else start), (start + 50 if part == "early" else end)

    def _century(self, match):
        found, before = match.groupdict(), self._before(match)
        start, end = self._range(self.numbers[found["n"].lower()], PARTS.get((found.get("part") or "").lower()), before)
        # "the first centuries" are the named one and the two that follow
        return start, end + (200 if (found.get("eeuw") or "").lower() == "eeuwen" and not before else 0), "century_expression", "medium"

    def _centuries(self, match):
        before = self._before(match)
        ranges = [self._range(self.numbers[match[k].lower()], None, before) for k in ("n", "m")]
        return min(r[0] for r in ranges), max(r[1] for r in ranges), "century_expression", "medium"

    def _years(self, match):
        a = int(match["a"])
        b = int(match["b"]) if match["b"] else a
        return (-a, -b, "explicit_range", "high") if self._before(match) else (a, b, "explicit_range", "high")

    def _period(self, match):
        part = PARTS[match["part"].lower()]
        return (*self.periods[part], "broad_period", "low") if part in self.periods else None

    def signals(self, text: str | None) -> list[tuple]:
        """(expression, start, end, type, precision) in order of precedence, then of place."""
        taken, out = [], []
        for pattern, read in self.productions:
            for match in pattern.finditer(text or ""):
                if any(match.start() < e and s < match.end() for s, e in taken):
                    continue
                found = read(match)
                if found:
                    taken.append(match.span())
                    out.append((match[0].strip(), min(found[:2]), max(found[:2]), *found[2:]))
        return out


#: What a text holds that any production matches: a word for centuries, a period's name, or an era beside a number.
DATED = r"(?i)eeuw|centur|roman|romein|\b(?:AD|BC)\s*\d|\d\s*(?:CE|BCE|BC|AD|[nv]\.Chr\.)"
_grammars: dict[int, SignalGrammar] = {}


def date_signals(text: Column) -> Column:
    """An array of signals. Span claims run in order, so this is an Arrow-batched function.

    Texts without any word or sign that all productions need do not reach it.
    """

    @F.pandas_udf(ArrayType(SIGNAL))
    def parse(texts: pd.Series) -> pd.Series:
        grammar = _grammars.setdefault(0, SignalGrammar())
        return texts.map(lambda t: [dict(zip(SIGNAL.names, s)) for s in grammar.signals(t)])

    return parse(F.when(text.rlike(DATED), text))


def reconcile(vocab_start: Column, vocab_end: Column, signals: Column, confidence: Column) -> Column:
    """One decision from a vocabulary date and the text's signals.

    A struct of start, end, method, confidence and conflict. Signals above low precision
    form the text's envelope; low ones count only where nothing else is known.
    """
    firm = F.filter(signals, lambda s: s["precision"] != "low")
    used = F.when(F.size(firm) > 0, firm).otherwise(signals)
    low, high = F.array_min(F.transform(used, lambda s: s["start"])), F.array_max(F.transform(used, lambda s: s["end"]))
    has = lambda p: F.exists(signals, lambda s: s["precision"] == p)
    text = F.coalesce(F.size(signals), F.lit(0)) > 0
    vocab = vocab_start.isNotNull() & vocab_end.isNotNull()
    all_high = F.forall(signals, lambda s: s["precision"] == "high")

    def decision(start: Column, end: Column, method: str, conf: Column, conflict: bool = False) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(method).alias("method"), conf.cast("double").alias("confidence"), F.lit(conflict).alias("conflict"))

    nothing = F.lit(None)
    at_most = lambda x: F.least(confidence.cast("double"), F.lit(x))
    apart = ~overlaps(vocab_start, vocab_end, low, high)
    within = (low >= vocab_start) & (high <= vocab_end) & ((low > vocab_start) | (high < vocab_end))
    text_conf = F.when(has("high"), 0.85).when(has("medium"), 0.70).otherwise(0.55)
    return (F.when(~vocab & ~text, decision(nothing, nothing, "unassigned", F.lit(0.0)))
            .when(~text, decision(vocab_start, vocab_end, "typological_direct", at_most(0.9)))
            .when(~vocab, decision(low, high, "text_only", text_conf))
            .when(apart & all_high, decision(low, high, "text_overrides_typology", F.lit(0.70), True))
            .when(apart, decision(vocab_start, vocab_end, "conflict_flagged", F.lit(0.30), True))
            .when(F.size(firm) == 0, decision(vocab_start, vocab_end, "typological_direct", at_most(0.9)))
            .when(within, decision(low, high, "combined_narrowed", at_most(0.95)))
            .otherwise(decision(vocab_start, vocab_end, "typological_direct", at_most(0.9))))


def best_date(candidates: list[tuple[str, Column]]) -> Column:
    """The first rung of a ladder that has a range: (method, struct of start and end), best first."""
    rungs = [F.when(c["start"].isNotNull() | c["end"].isNotNull(), F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(m).alias("method"))) for m, c in candidates]
    return F.coalesce(*rungs)


def narrowest(ranges: Column) -> Column:
    """The narrowest of an array of ranges; of equals the first."""
    widths = F.transform(ranges, lambda r, i: F.struct((r["end"] - r["start"]).alias("width"), i.alias("i"), r["start"].alias("start"), r["end"].alias("end")))
    return F.array_min(widths)
