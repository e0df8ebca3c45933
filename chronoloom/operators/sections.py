"""Sections, overlapping windows, sentences and positions: operators on sequences of lines.

Sequences stay inside one report: every window is partitioned by it, and character offsets
are running sums. Windows of a text are generated by arithmetic, without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..shared import materialise
from .spans import matches_of

CHUNK, OVERLAP = 1200, 150


def running(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def collapse_spaced_capitals(title: Column, stop: tuple[str, ...] = ()) -> Column:
    """``A M B I J.`` is Ambij; null for fewer than three letters and for words in ``stop``."""
    bare = F.btrim(title, F.lit(" ."))
    joined = F.initcap(F.lower(F.replace(bare, F.lit(" "), F.lit(""))))
    return F.when(bare.rlike(r"^\p{L}(?:\s+\p{L}){2,}$") & ~F.lower(joined).isin(list(stop) or [""]), joined)


def heading_of(line: Column, previous: Column, following: Column, places: list[str], keywords: list[str], provinces: list[str], stop: tuple[str, ...] = ()) -> Column:
    """STRUCT(title, site, rest) of a line that opens a section, else null.

    In order: a place with a province and text behind it; a place of the gazetteer in
    capitals, with a province, or alone; letter-spaced capitals; a short keyword heading
    that does not stand between two figures of a table.
    """
    def found(title: Column, site: Column, rest: Column) -> Column:
        return F.struct(title.alias("title"), site.alias("site"), rest.alias("rest"))

    province = r"(?:" + "|".join(provinces) + r")\.?"
    inline = r"^(\p{Lu}[\p{L}'’-]+(?:\s\p{Lu}[\p{L}'’-]+)*)\s*\((?i:" + province + r")\)\.\s*(.*)$"
    place = r"(?i)^(" + "|".join(sorted(places, key=lambda p: (-len(p), p))) + r")\s*(?:\(([a-z.]{1,6})\))?\s*[.:]\s*(.*)$"
    name, prov, rest = (F.regexp_extract(line, place, k) for k in (1, 2, 3))
    stands_out = (name == F.upper(name)) | (prov != "") | (F.trim(rest) == "")
    figure = lambda c: F.coalesce(F.trim(c).rlike(r"^\d+$"), F.lit(False))
    keyword = r"(?i)^(?:\d+(?:\.\d+)*\.?\s+)?(?:" + "|".join(keywords) + r")\b[ .:—-]*([^,]{0,30})$"
    none = F.lit(None).cast("string")
    return (F.when(line.rlike(inline), found(F.regexp_extract(line, inline, 1), F.regexp_extract(line, inline, 1), F.regexp_extract(line, inline, 2)))
            .when(line.rlike(place) & stands_out, found(F.initcap(F.lower(name)), F.initcap(F.lower(name)), F.trim(rest)))
            .when(line.rlike(r"^\p{Lu}(?:\s+\p{Lu}){2,}\s*\.?$"), found(line, collapse_spaced_capitals(line, stop), none))
            .when(line.rlike(keyword) & ~(figure(previous) & figure(following)), found(line, none, none)))


def mark_headings(lines: DataFrame, keys: list[str], order: list[str], **recogniser) -> DataFrame:
    """Non-empty lines with a ``heading`` column, looking at both neighbours."""
    rows = lines.withColumn("line", F.trim("line")).where("line <> ''")
    place = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumns({"_before": F.lag("line").over(place), "_after": F.lead("line").over(place)})
    return rows.withColumn("heading", heading_of(F.col("line"), F.col("_before"), F.col("_after"), **recogniser)).drop("_before", "_after")


def section_parts(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``lines`` with the number of their section, their part of its text and that part's offset in it."""
    rows = lines.withColumn("section_no", F.sum(F.when(F.col("heading").isNotNull(), 1).otherwise(0)).over(running(keys, order)) + 1)
    rows = rows.withColumn("part", F.when(F.col("heading").isNull(), F.col("line")).otherwise(tx.blank_to_null(F.col("heading.rest"))))
    earlier = Window.partitionBy(*keys, "section_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.length("part") + 1).over(earlier), F.lit(0)))


def sections(lines: DataFrame, keys: list[str], order: list[str], page: str) -> DataFrame:
    """Gaps and islands: a line with a heading opens a section, the rest of the line is its first part.

    ``lines`` has ``line`` and ``heading``. Sections are numbered from 1 over all headings;
    those without any text are left out but keep their number. ``page_breaks`` holds
    (page, offset) of each page's first part.
    """
    rows, inside = section_parts(lines, keys, order), [*keys, "section_no"]
    part = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col("offset"), F.col(page).alias("page"), F.col("part"))
    grouped = rows.groupBy(*inside).agg(
        F.max("heading.title").alias("section_title"), F.max("heading.site").alias("site_name"), F.min(page).alias("page_start"), F.max(page).alias("page_end"),
        F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), part))).alias("_parts"),
    )
    grouped = grouped.where(F.size("_parts") > 0)
    text = F.array_join(F.transform("_parts", lambda p: p["part"]), "\n")
    opens = F.filter("_parts", lambda p, i: (i == 0) | (F.get(F.col("_parts"), i - 1)["page"] != p["page"]))
    breaks = F.transform(opens, lambda p: F.struct(p["page"].alias("page"), p["offset"].cast("int").alias("offset")))
    return grouped.select(*inside, F.coalesce("section_title", F.lit("Unlabeled Section")).alias("section_title"), "site_name", "page_start", "page_end", breaks.alias("page_breaks"), text.alias("text"))


def chunk_breaks(breaks: Column, start: Column, size: int) -> Column:
    """The page that is open at a window's start, and the breaks strictly inside the window."""
    inside = F.filter(breaks, lambda b: (b["offset"] > start) & (b["offset"] < start + size))
    open_page = F.element_at(F.filter(breaks, lambda b: b["offset"] <= start), -1)["page"]
    shifted = F.transform(inside, lambda b: F.struct(b["page"].alias("page"), (b["offset"] - start).cast("int").alias("offset")))
    return F.concat(F.array(F.struct(open_page.alias("page"), F.lit(0).alias("offset"))), shifted)


def chunks(rows: DataFrame, text: str = "text", size: int = CHUNK, overlap: int = OVERLAP, breaks: str | None = None) -> DataFrame:
    """Overlapping windows: a text of up to ``size`` is one window, others start every size - overlap.

    Adds chunk_no, text_offset_start, is_full_section and chunk_text. The last window is the
    first that reaches the end; windows are trimmed but keep their offset. Null and empty texts
    have no window.
    """
    step = max(1, size - overlap)
    n = F.length(text)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil((n - size) / step).cast("int") * step, F.lit(step)))
    out = rows.where(n > 0).select("*", F.posexplode(starts).alias("chunk_no", "text_offset_start"))
    out = out.withColumn("is_full_section", n <= size)
    whole = F.col(text)
    part = F.btrim(F.substring(whole, F.col("text_offset_start") + 1, F.lit(size)), F.lit(" \n\t\r"))
    out = out.withColumn("chunk_text", F.when(F.col("is_full_section"), whole).otherwise(part)).where("chunk_text <> ''")
    return out.withColumn("page_breaks", chunk_breaks(F.col(breaks), F.col("text_offset_start"), size)) if breaks else out


def section_chunks(lines: DataFrame, keys: list[str], order: list[str], page: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The ``chunks`` of ``sections`` with their page breaks, for sections of any length.

    Every part of a section goes to the windows that it reaches into, so no row holds more than
    a line or a window. The parts are written first: they are read for the sections' lengths too.
    """
    step, inside = max(1, size - overlap), [*keys, "section_no"]
    earlier = Window.partitionBy(*inside).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("part").isNotNull(), F.col(page)), ignorenulls=True).over(earlier)
    rows = section_parts(lines, keys, order).withColumn("_before", before)
    rows = materialise(rows.select(*inside, F.col("heading.title").alias("_title"), F.col("heading.site").alias("_site"), F.col(page).alias("_page"), "_before", F.col("offset").cast("long").alias("offset"), "part"), "parts")
    end = F.col("offset") + F.length("part")
    about = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in inside]).agg(
        F.coalesce(F.max("_title"), F.lit("Unlabeled Section")).alias("section_title"), F.max("_site").alias("site_name"), F.min("_page").alias("page_start"), F.max("_page").alias("page_end"), F.max(end).alias("_n"),
    )
    of = ["section_title", "site_name", "page_start", "page_end", "_n"]
    rows = rows.where("part is not null").join(about, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in inside]))
    # a part begins with the line break before it
    begin, body = F.greatest(F.col("offset") - 1, F.lit(0)), F.when(F.col("offset") > 0, F.concat(F.lit("\n"), "part")).otherwise(F.col("part"))
    low = F.greatest(F.lit(0), F.floor((begin - size) / step) + 1)
    high = F.least(F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / step)), F.floor((end - 1) / step))
    rows = rows.select(*inside, *of, "_page", "_before", "offset", begin.alias("_begin"), end.alias("_end"), body.alias("_body"), F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))).alias("chunk_no"))
    start = F.col("chunk_no") * step
    at = F.greatest(start.cast("long"), F.col("_begin"))
    piece = F.substring(F.col("_body"), (at - F.col("_begin") + 1).cast("int"), (F.least(start + size, F.col("_end")) - at).cast("int"))
    pieces = F.array_sort(F.collect_list(F.struct("offset", "_page", "_before", piece.alias("piece"))))
    out = rows.groupBy(*inside, *of, "chunk_no").agg(pieces.alias("_pieces")).withColumn("text_offset_start", start.cast("int")).withColumn("is_full_section", F.col("_n") <= size)
    text, first, start = F.array_join(F.transform("_pieces", lambda p: p["piece"]), ""), F.get("_pieces", F.lit(0)), F.col("text_offset_start")
    out = out.withColumn("chunk_text", F.when(F.col("is_full_section"), text).otherwise(F.btrim(text, F.lit(" \n\t\r")))).where("chunk_text <> ''")
    broken = F.filter("_pieces", lambda p: (p["offset"] > start) & (p["offset"] < start + size) & (p["_before"] != p["_page"]))
    shifted = F.transform(broken, lambda p: F.struct(p["_page"].alias("page"), (p["offset"] - start).cast("int").alias("offset")))
    opened = F.struct(F.when(first["offset"] <= start, first["_page"]).otherwise(first["_before"]).alias("page"), F.lit(0).alias("offset"))
    return out.withColumn("page_breaks", F.concat(F.array(opened), shifted)).drop("_pieces", "_n")


def page_at(breaks: Column, offset: Column) -> Column:
    """As of: the page of the last break at or before an offset, else the first page."""
    return F.coalesce(F.element_at(F.filter(breaks, lambda b: b["offset"] <= offset), -1)["page"], F.get(breaks, 0)["page"])


#: A point, white space and a capital or bracket; not after a capital or a digit.
SENTENCE_END = r"(?<![A-Z\d])\.[ \t\r\n]+(?=[A-Z(])"


def sentences(rows: DataFrame, text: str = "text", pattern: str = SENTENCE_END) -> DataFrame:
    """(…, sentence_no, sentence): one row per sentence of each text, without its end mark."""
    return rows.select("*", F.posexplode(F.split(F.col(text), pattern, -1)).alias("sentence_no", "sentence"))


def context(text: Column, start: Column, end: Column, width: int = 300) -> Column:
    """``width`` characters on both sides of a span."""
    low = F.greatest(F.lit(0), start - width)
    return F.substring(text, (low + 1).cast("int"), (end + width - low).cast("int"))


def around(rows: DataFrame, keys: list[str], before: int, after: int, value: str = "sentence", order: str = "sentence_no", out: str = "context") -> DataFrame:
    """The neighbouring sentences of each sentence, joined by a space."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)
    return rows.withColumn(out, F.array_join(F.collect_list(value).over(frame), " "))


def clause_after(text: Column) -> Column:
    """Up to the next comma, semicolon, colon or point."""
    return F.regexp_extract(text, r"^[^,;:.]*", 0)


def sentence_or_line(sentence: Column, line: Column, most: int = 300) -> Column:
    return F.when(F.length(sentence) > most, line).otherwise(sentence)


def is_table_cell(line: Column, before: Column, after: Column, most: int = 60, short: int = 12) -> Column:
    """A short line with a very short neighbour reads as a cell, whose own line is its context."""
    near = lambda c: F.coalesce(F.length(c) <= short, F.lit(False))
    return (F.length(line) <= most) & (near(before) | near(after))


def forward_fill(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """The last value at or above each row."""
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(running(keys, order)))


def quote_context(text: Column, quote: Column, width: int = 240, prefix: int = 60) -> Column:
    """``width`` characters around a quote, or around its first ``prefix`` characters; null if neither is there."""
    at = F.coalesce(F.nullif(F.instr(text, quote), F.lit(0)), F.nullif(F.instr(text, F.left(quote, F.lit(prefix))), F.lit(0)))
    low = F.greatest(F.lit(1), at - width)
    return F.when(at.isNotNull(), F.substring(text, low, at + F.length(quote) + width - low))


#: A line that begins with a word of capitals and a colon or point, and one that is a site's code.
CATEGORY = r"(?md)^[ \t]*[A-ZÀ-Þ]{4,}(?:[ \t]+[A-ZÀ-Þ]{2,})*\s*[:.]"
SITE_CODE = r"(?md)^[ \t]*\d{6}[ \t]*$"


def slice_of(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), F.greatest(F.lit(0), end - start).cast("int"))


def category_block(text: Column, at: Column, labels: Column | None = None) -> Column:
    """The text before the first category label, and the block of the label that governs a place.

    ``labels`` are the label's spans, where they are known. The whole text if it has none.
    """
    starts = F.transform(F.coalesce(matches_of(text, CATEGORY) if labels is None else labels, F.array()), lambda m: m["start"])
    first, own = F.get(starts, 0), F.coalesce(F.array_max(F.filter(starts, lambda s: s <= at)), F.lit(0))
    end = F.coalesce(F.array_min(F.filter(starts, lambda s: s > own)), F.length(text))
    block = slice_of(text, own, end)
    return F.when(first.isNull(), text).when(own == 0, block).otherwise(F.concat(slice_of(text, F.lit(0), first), F.lit("\n"), block))


def sentences_around(text: Column, start: Column, end: Column, before: int, after: int, bounds: Column | None = None, least: int = 0) -> Column:
    """A span with so many sentence ends before and after it; ``least`` characters from ``start`` on if there are as many."""
    ends = F.coalesce(matches_of(text, SENTENCE_END) if bounds is None else bounds, F.array())
    earlier, later = F.filter(ends, lambda m: m["end"] <= start), F.filter(ends, lambda m: m["start"] >= end)
    low = F.coalesce(F.get(earlier, F.size(earlier) - before)["end"], F.lit(0)) if before else start
    high = F.greatest(F.coalesce(F.get(later, F.lit(after - 1))["start"] + 1, F.length(text)), F.least(start + least, F.length(text)))
    return F.btrim(slice_of(text, low, high), F.lit(" \n\t\r"))


def site_code_before(text: Column, at: Column, codes: Column | None = None) -> Column:
    """The last line that is a site's code and begins at or above a place."""
    above = F.filter(F.coalesce(matches_of(text, SITE_CODE) if codes is None else codes, F.array()), lambda m: m["start"] <= at)
    return F.trim(F.btrim(F.get(above, F.size(above) - 1)["term"], F.lit(" \t")))


def site_focus(text: Column, caption: str = r"(?i)^(?:fig|afb|plate|tabel|table)\b", head: int = 1500, most: int = 3000) -> Column:
    """The beginning of a report and its distinct caption lines, up to ``most`` characters."""
    captions = F.array_distinct(F.filter(tx.lines_of(text), lambda line: line.rlike(caption)))
    return F.left(F.concat_ws("\n", F.left(text, F.lit(head)), F.array_join(captions, "\n")), F.lit(most))


def pack_pages(pages: DataFrame, budget: int, shared: int = 2, report: str = "report_id", page: str = "page_number", text: str = "text", listed: bool = False) -> DataFrame:
    """Windows of whole pages within a character budget that share their last pages.

    (report, window_no, page_from, page_to, n_chars), and the array page_numbers if they are to be ``listed``. Where a window ends depends on where the
    one before it began, so a report's page lengths (not its texts) are packed in order.
    """
    import pandas as pd

    sizes = pages.select(report, page, F.coalesce(F.length(text), F.lit(0)).alias("n"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(page)
        numbers, lengths = rows[page].tolist(), rows["n"].tolist()
        out, first = [], 0
        while first < len(numbers):
            last, held = first, lengths[first]
            while last + 1 < len(numbers) and held + lengths[last + 1] <= budget:
                last += 1
                held += lengths[last]
            out.append((rows[report].iloc[0], len(out), numbers[first], numbers[last], held, *[numbers[first : last + 1]] * listed))
            if last + 1 >= len(numbers):
                break
            first = max(first + 1, last + 1 - shared)
        return pd.DataFrame(out, columns=[report, "window_no", "page_from", "page_to", "n_chars", *["page_numbers"] * listed])

    kinds = dict(pages.dtypes)
    return sizes.groupBy(report).applyInPandas(pack, f"{report} {kinds[report]}, window_no int, page_from {kinds[page]}, page_to {kinds[page]}, n_chars long" + f", page_numbers array<{kinds[page]}>" * listed)
