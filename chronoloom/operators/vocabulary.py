"""Vocabulary and pattern compilers: from vocabulary rows to pattern rows and back, and from triples to maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.predicates import is_named_ware, is_safe_code
from .names import first_ancestor


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([.^$*+?()\[\]{}|\\/-])", r"\\$1")


def code_regex(code: Column) -> Column:
    """Any white space, hyphen or ``type`` between the words; white space around slashes."""
    words = F.transform(F.split(F.trim(code), r"\s+"), lambda w: F.replace(escaped(w), F.lit(r"\/"), F.lit(r"\s*/\s*")))
    return F.array_join(words, r"[\s\-]*(?:type\s+)?")


def name_regex(name: Column) -> Column:
    words = F.filter(F.split(F.trim(name), r"[\s,]+"), lambda w: w != "")
    return F.array_join(F.transform(words, escaped), r"[\s,]+")


def longest_first(parts: Column) -> Column:
    return F.transform(F.array_sort(F.transform(F.array_distinct(parts), lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), lambda s: s["p"])


def pattern_rows(vocabulary: DataFrame, named: Column | None = None, code: str = "code") -> DataFrame:
    """One pattern per row with a safe code: its forms and abbreviations as codes, its names (where ``named``; by default specific names of wares) as words.

    ``vocabulary`` has the code, all_forms and abbreviations (``|``-separated), name, date_start, date_end.
    """
    vocabulary, named = vocabulary.where(is_safe_code(F.col(code))), is_named_ware(F.col("name")) if named is None else named
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    codes = F.transform(F.array_union(F.array_union(F.array(F.trim(code)), split("all_forms")), split("abbreviations")), code_regex)
    names = F.when(named, F.array(name_regex(F.col("name")))).otherwise(F.array().cast("array<string>"))
    body = F.array_join(longest_first(F.concat(codes, names)), "|")
    hint = F.regexp_replace(F.upper(code), r"[^A-Z0-9]+", "_")
    return vocabulary.select(F.concat(F.lit("csv_pottery_"), tx.canonical_code(F.col(code))).alias("pattern_id"), F.concat(F.lit(r"\b(?:"), body, F.lit(r")\b")).alias("regex"), F.btrim(hint, F.lit("_")).alias("canonical_hint"), F.col("name").alias("preferred_label"), "date_start", "date_end")


def grouped_patterns(rows: DataFrame, code: str = "code") -> DataFrame:
    """The older layout: one pattern per base code and date, with all its names."""
    base = F.trim(F.split(code, ":")[0])
    return rows.groupBy(base.alias("base_code"), "date_start", "date_end").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"), F.count("*").alias("n_rows"))


def century_pairs(centuries: DataFrame) -> DataFrame:
    """Neighbouring centuries of each era as one range, in order of their start.

    ``centuries`` has n, era (``bc`` or ``ad``), date_start and date_end.
    """
    order = Window.partitionBy("era").orderBy("date_start")
    rows = centuries.withColumns({"_n": F.lead("n").over(order), "_e": F.lead("date_end").over(order)}).where("_n is not null")
    return rows.select(F.concat_ws("_", F.lit("century_range"), "n", "_n", "era").alias("pattern_id"), F.upper(F.concat_ws("_", F.lit("century_range"), "n", "_n", "era")).alias("canonical_hint"), "date_start", F.col("_e").alias("date_end"))


def term_patterns(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Distinct terms of several columns, whatever their case; the first spelling stays."""
    terms = F.filter(F.transform(F.array(*columns), lambda x: F.trim(x)), lambda t: t.isNotNull() & (t != ""))
    low = F.transform(terms, F.lower)
    first = F.filter(terms, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    return rows.select(key, F.concat(F.lit(r"(?i)\b(?:"), F.array_join(F.transform(longest_first(first), escaped), "|"), F.lit(r")\b")).alias("regex"), F.size(first).alias("n_terms"))


def pattern_terms(patterns: DataFrame) -> DataFrame:
    """The terms of each pattern, for review: its alternatives without their regular-expression marks."""
    body = F.regexp_replace(F.col("regex"), r"^(?:\(\?i\))?\\b\(\?:|\)\\b$", "")
    plain = lambda t: F.regexp_replace(tx.swap(t, ((r"\[\\s\\-\]\*\(\?:type\\s\+\)\?|\[\\s,\]\+|\\s\+", " "), (r"\\s\*/\\s\*", "/"))), r"\\(.)", "$1")
    return patterns.select("pattern_id", F.explode(F.transform(F.split(body, r"\|"), plain)).alias("term"))


def abbreviations_of(code: Column, series: dict[str, str]) -> Column:
    """``Dragendorff 37`` as Drag. 37 and Drag 37, by a table of series and their short forms."""
    made = [F.when(F.startswith(code, F.lit(f"{long} ")), F.array(F.replace(code, F.lit(long), F.lit(f"{short}.")), F.replace(code, F.lit(long), F.lit(short)))) for long, short in series.items()]
    return F.coalesce(*made, F.array().cast("array<string>"))


def merged_codes(rows: DataFrame, code: str = "code") -> DataFrame:
    """Repeated codes as one row: the widest date, and the name of its first row."""
    return rows.groupBy(code).agg(F.min("date_start").alias("date_start"), F.max("date_end").alias("date_end"), F.min_by("name", "position").alias("name"))


#: Hedges and words before a typology, and names of series that make an unknown value a gap of the list.
QUALIFIER = r"(?iu)\b(?:cf\.?|vgl\.?|sim\.?|var\.?|type|typ|proche\s+de|aehnlich|ähnlich)\b|-?achtig\b"
TYPE_SERIES = r"(?i)\b(?:alzey|holwerda|niederbieber|nb|dragendorff|drag|trier|mayen|stuart|brunsting|gose|chenet|hofheim|hbw|bw|fg)\b"


def review_typologies(gold: DataFrame, master: DataFrame, typology: str = "typology", code: str = "code") -> DataFrame:
    """One row per distinct typology of ``gold``: what the ``master`` list makes of it.

    (typology_raw, typology_normalized, stripped_qualifier, resolved_code, master_gap, not_typology,
    status). ``matched`` has a code of the list, by the code itself before one of its forms or
    abbreviations (``all_forms``, ``abbreviations``, ``|``-separated; of several codes the first by
    ``position``); ``master_gap`` looks like a type, by a series' name or a digit; else it is
    ``not_typology``. Blank typologies have no row.
    """
    listed = master.withColumn("_code", F.trim(code)).where("_code <> ''")
    split = lambda c: F.split(F.coalesce(c, F.lit("")), r"\|")
    own = listed.select(F.lower("_code").alias("_key"), F.struct(F.lit(0).alias("rank"), (-F.col("position")).alias("at"), F.col("_code").alias("code")).alias("_hit"))
    forms = listed.select(F.explode(F.concat(split("all_forms"), split("abbreviations"))).alias("_form"), F.struct(F.lit(1).alias("rank"), F.col("position").alias("at"), F.col("_code").alias("code")).alias("_hit"))
    forms = forms.select(F.lower(F.trim("_form")).alias("_key"), "_hit").where("_key <> ''")
    index = own.unionByName(forms).groupBy("_key").agg(F.min("_hit").alias("_hit"))
    rows = gold.select(F.trim(typology).alias("typology_raw")).where("typology_raw <> ''").distinct()
    found = F.regexp_extract_all("typology_raw", F.lit(QUALIFIER), F.lit(0))
    clean = F.btrim(F.regexp_replace(F.regexp_replace("typology_raw", QUALIFIER, " "), r"\s+", " "), F.lit(" ,.;"))
    rows = rows.withColumns({"typology_normalized": clean, "stripped_qualifier": F.array_join(F.transform(found, lambda q: F.trim(q)), " ")})
    rows = rows.join(index, F.lower("typology_normalized") == F.col("_key"), "left")
    known, typed = F.col("_hit").isNotNull(), F.col("typology_normalized").rlike(TYPE_SERIES) | F.col("typology_normalized").rlike(r"\d")
    status = F.when(known, "matched").when(typed, "master_gap").otherwise("not_typology")
    shown = lambda s: F.when(status == s, F.col("typology_normalized")).otherwise("")
    return rows.select("typology_raw", "typology_normalized", "stripped_qualifier", F.coalesce("_hit.code", F.lit("")).alias("resolved_code"), shown("master_gap").alias("master_gap"), shown("not_typology").alias("not_typology"), status.alias("status"))


# --- maps out of triples (s, p, o)


def single_value(triples: DataFrame, predicate: str, out: str) -> DataFrame:
    """(s, out): of several values of a property the smallest."""
    return triples.where(F.col("p") == predicate).groupBy("s").agg(F.min("o").alias(out))


def combined_map(triples: DataFrame, label: str, notation: str, category: str, broader: str, status: str, final: str) -> DataFrame:
    """One row per final term with a ware category: its code, label, ware, form and typology.

    The form is the first broader term without a category; the typology follows the first
    dash of the label.
    """
    labels, codes, cats = single_value(triples, label, "label"), single_value(triples, notation, "code"), single_value(triples, category, "ware")
    nodes = triples.select(F.col("s").alias("node")).distinct().join(cats.select(F.col("s").alias("node"), F.lit(False).alias("ok")), "node", "left").withColumn("ok", F.coalesce("ok", F.lit(True)))
    forms = first_ancestor(nodes, triples.where(F.col("p") == broader).select(F.col("s").alias("node"), F.col("o").alias("parent")), "ok").select(F.col("node").alias("s"), F.col("ancestor").alias("form"))
    done = triples.where((F.col("p") == status) & (F.col("o") == final)).select("s").distinct()
    name = lambda key, out: labels.select(F.col("s").alias(key), F.col("label").alias(out))
    rows = cats.join(done, "s", "left_semi").join(labels, "s", "left").join(codes, "s", "left").join(forms, "s", "left").join(name("ware", "ware_label"), "ware", "left").join(name("form", "form_label"), "form", "left")
    form_codes = codes.select(F.col("s").alias("form"), F.col("code").alias("form_code"))
    typology = F.trim(F.regexp_extract("label", r"-\s+(.*)$", 1))
    return rows.join(form_codes, "form", "left").select("code", "label", F.col("s").alias("uri"), "ware_label", "form_code", "form_label", typology.alias("typology"))
