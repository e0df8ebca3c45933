"""How a sentence refers to a term: cue expressions and the classifier."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Cues(NamedTuple):
    """Expressions for each kind of sentence, in the order in which they are asked."""

    historiographic: str
    bibliographic: str
    finds: str
    absent: str
    comparison: str
    uncertain: str
    present: str


#: The cue words. ``cf.`` needs a word character behind its point to count.
REPORT_CUES = Cues(
    historiographic=r"(?iU)\bsince the\b|\bhistory of\b|\bresearch history\b|\bonderzoeksgeschiedenis\b|\bonderzoeksoverzicht\b|\bhistorisch kader\b|\bstand van het onderzoek\b|\bliteratuuroverzicht\b|\bhistoriografisch\b|\bhistoriographic\b|\bstate of research\b|\bscholarly history\b",
    bibliographic=r"(?U)\([Ee]ds?\)(?:\s*\(\d{4}[a-z]?\)|\s+[A-Z])|\(\d{4}[a-z]?\)\s+[A-Z]|\(\d{4}[a-z]?\),\s|\b[Ee]t al\.\s*\(\d{4}[a-z]?\)|\b[Pp]p?\.\s*\d+|\b[Vv]ol\.\s*\d+|\b\d{4}[a-z]\b|(?<!\()[A-Z][a-z]+\s+\d{4}\)",
    finds=r"(?iU)\b(gevonden|aangetroffen|found|recovered|discovered|dates|dateert|aanwezig|identified|recorded|established|emerged|founded|constructed|built|inhabited|occupied|settled|evidenced|attested|demonstrated|recognised|recognized|shows?|displays?|bewoning|nederzetting|vondsten|sporen|urnenveld|schatvondst)\b",
    absent=r"(?iU)\b(could not be assigned|not found|not present|absent|not recorded|not attested|nowhere found|never found|nergens aangetroffen|nergens gevonden|nooit aangetroffen|nooit gevonden|nog niet aangetroffen|nog niet gevonden|niet meer aangetroffen|niet meer gevonden|niet aangetroffen|niet gevonden|ontbreekt|ontbreken|geen sporen van|geen aanwijzingen voor|geen vondsten|afwezig|niet bewaard|niet gedocumenteerd|niet herkend|buiten het plangebied|buiten beschouwing)\b",
    comparison=r"(?iU)\b(vergelijkbaar|similar to|comparable to|resembles|cf\.|compare)\b",
    uncertain=r"(?iU)\b(may indicate|possibly|perhaps|could be|might|mogelijk|waarschijnlijk|probably|could not be dated)\b",
    present=r"(?iU)\b(gevonden|aangetroffen|found|recovered|discovered|dates|dateert|aanwezig|identified|recorded|established|emerged|founded|constructed|built|inhabited|occupied|settled|consists?\s+of|comprised\s+of|evidenced|attested|demonstrated|recognised|recognized|shows?|displays?|depicted|marked\s+with|inscribed|bewoning|nederzetting|vondsten|sporen|urnenveld|schatvondst|uit\s+de\s+(?:Romeinse|IJzer|Midden|Late|Vroege))\b",
)


def classify_context(sentence: Column, pattern_id: Column, century: Column, before: Column, cues: Cues = REPORT_CUES, prefix: str = "csv_pottery_", later: int = 15, earlier: int = 3) -> Column:
    """STRUCT(label, confidence) of one mention.

    A match of the typology vocabulary is present by definition. Centuries from ``later`` on
    and, before our era, from ``earlier`` on are irrelevant. Then come the cues in order.
    """
    text = F.trim(F.regexp_replace(F.coalesce(sentence, F.lit("")), r"(?U)\s+", " "))

    def verdict(label: str, confidence: float) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))

    return (F.when(F.coalesce(pattern_id.startswith(prefix), F.lit(False)), verdict("present", 0.95))
            .when(~before & (century >= later), verdict("irrelevant", 0.95))
            .when(before & (century >= earlier), verdict("irrelevant", 0.92))
            .when(text.rlike(cues.historiographic), verdict("irrelevant", 0.85))
            .when(text.rlike(cues.bibliographic) & ~text.rlike(cues.finds), verdict("irrelevant", 0.90))
            .when(text.rlike(cues.absent), verdict("absent", 0.90))
            .when(text.rlike(cues.comparison), verdict("comparison", 0.90))
            .when(text.rlike(cues.uncertain), verdict("uncertain", 0.70))
            .when(text.rlike(cues.present), verdict("present", 0.85))
            .otherwise(verdict("uncertain", 0.30)))


def needs_second_opinion(confidence: Column, threshold: float = 0.75) -> Column:
    """Mentions that go to the model adapter, if one is plugged in."""
    return confidence < threshold


def eligible_for_dating(label: Column, confidence: Column, with_uncertain: bool = False, least: float = 0.5) -> Column:
    """Whether a mention is dated, and why not: present and comparison are, uncertain on request."""
    return (F.when(label.isin("present", "comparison"), F.lit("eligible"))
            .when((label == "uncertain") & F.lit(with_uncertain) & (confidence >= least), F.lit("eligible"))
            .otherwise(F.concat(F.lit("skipped_"), label)))
