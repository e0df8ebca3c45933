"""Resolution of finds to a controlled vocabulary of wares, forms and their combinations.

All maps are DataFrames: ``wares`` (code, label, aliases), ``forms`` (code, label, aliases),
``combined`` (code, label, ware_label, form_code, typology) and ``master`` (typology, ware, form);
aliases are separated by ``|``. Finds have find_id, typology, name and context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .matching import longest_keyword

#: Words for production regions, and the qualifier in a typology's label.
REGIONS = (
    ("zuidgallisch", ("zuid-gallisch", "zuidgallisch", "south gaulish", "graufesenque", "montans")),
    ("oostgallisch", ("oost-gallisch", "oostgallisch", "central gaulish", "east gaulish", "lezoux", "rheinzabern", "mittelgallisch")),
    ("argonnen", ("argonne", "argonnen")),
    ("arretijns", ("arretine", "arretijns", "arezzo", "arretina")),
)
#: Forms that only a find's own name can give.
NAME_ONLY_FORMS = ("BEELD", "ROOSTER", "MISBAKSL")


def region_of(text: Column) -> Column:
    low = F.lower(text)
    hits = [F.when(low.rlike("|".join(words)), F.lit(name)) for name, words in REGIONS]
    return F.coalesce(*hits)


def keywords(vocabulary: DataFrame, root: bool) -> DataFrame:
    """(keyword, code, label): aliases, and the label's first word (wares) or the label (forms).

    Keywords that stand for several codes are left out: a guess is worse than none.
    """
    own = F.when(F.lit(root) & ~F.col("label").contains(",") & (F.length(F.split("label", " ")[0]) >= 5), F.split("label", " ")[0]).when(~F.lit(root) & (F.length("label") >= 4), F.col("label"))
    rows = vocabulary.select("code", "label", F.explode(F.concat(F.split(F.coalesce("aliases", F.lit("")), r"\|"), F.array(own))).alias("keyword"))
    rows = rows.select("code", "label", F.lower(F.trim("keyword")).alias("keyword")).where("keyword <> ''").distinct()
    place = Window.partitionBy("keyword")
    return rows.withColumns({"_a": F.min("code").over(place), "_b": F.max("code").over(place)}).where("_a = _b").drop("_a", "_b")


def typology_index(combined: DataFrame) -> DataFrame:
    """(key, exactness, …): the whole typology without its region, and each of its equivalents.

    Qualifiers after a colon may be left out. A whole typology (0) goes before an equivalent (1).
    Entries are in the order of ``position``, or of their codes where there is none.
    """
    base = F.split("typology", ",")[0]
    variants = lambda c: F.array(c, F.split(c, ":")[0])
    rows = combined.where(F.coalesce("typology", F.lit("")) != "")
    rows = rows if "position" in rows.columns else rows.withColumn("position", F.col("code"))
    whole = rows.select("*", F.explode(variants(base)).alias("_k"), F.lit(0).alias("exactness"))
    parts = rows.where(F.size(F.split(base, "/")) > 1).select("*", F.explode(F.flatten(F.transform(F.split(base, "/"), lambda p: variants(p)))).alias("_k"), F.lit(1).alias("exactness"))
    keyed = whole.unionByName(parts).withColumn("key", tx.spaced_alnum(F.col("_k"))).where("key <> ''").drop("_k")
    best = F.min(F.struct("exactness", "position", "label", "ware_label", "form_code", "typology")).alias("_b")
    return keyed.groupBy("key", "code").agg(best).select("key", "code", "_b.*")


def _matched(finds: DataFrame, text: Column, words: DataFrame, out: str) -> DataFrame:
    """(find_id, out): the code and label of the longest keyword in a text."""
    found = longest_keyword(finds.select("find_id", text.alias("_text")), words, ["find_id"], "_text", "keyword")
    return found.join(words, "keyword").select("find_id", F.struct("code", "label").alias(out))


def resolve(finds: DataFrame, wares: DataFrame, forms: DataFrame, combined: DataFrame, master: DataFrame, style: str = "ABR") -> DataFrame:
    """(find_id, seven std columns): blank where nothing resolves.

    1. A combined term of the typology: of the whole typology before its equivalents before its
       base without a variant letter; of its entries one without a region that agrees best with
       the name, else the one whose region the text names, else the only one.
    2. Otherwise ware and form from the master list, then from keywords, where the name
       outweighs the quote unless the quote refines it; then the combined term of both.
    A quote that several finds of a report share is not evidence for any of them. Of several
    entries under one key of a list the one that sorts first counts.
    """
    shared = F.count("*").over(Window.partitionBy("report_id", "context")) if "report_id" in finds.columns else F.count("*").over(Window.partitionBy("context"))
    finds = finds.withColumn("_trusted", shared == 1).withColumn("_full", F.concat_ws(" ", "name", "context"))
    hay = F.when(F.col("_trusted"), F.col("_full")).otherwise(F.col("name"))
    ware_words, form_words = keywords(wares, True), keywords(forms, False)
    for text, words, out in ((F.col("name"), ware_words, "name_ware"), (F.col("name"), form_words, "name_form"), (hay, ware_words, "any_ware"), (hay, form_words, "any_form")):
        finds = finds.join(_matched(finds, text, words, out), "find_id", "left")

    key = tx.spaced_alnum(F.coalesce("typology", F.lit("")))
    asked = finds.select("find_id", "name_ware", "name_form", "_full", F.explode(F.array(F.struct(F.lit(0).alias("try"), key.alias("key")), F.struct(F.lit(1).alias("try"), F.regexp_replace(key, r"(\d+)\s*[a-z]$", "$1").alias("key")))).alias("k"))
    ware_of = wares.select(F.col("code").alias("_wc"), tx.spaced_alnum(F.col("label")).alias("_wl"))
    index = typology_index(combined).join(ware_of, tx.spaced_alnum(F.col("ware_label")) == F.col("_wl"), "left")
    hits = asked.join(index, F.col("k.key") == F.col("key")).withColumn("_rank", F.col("k.try") * 2 + F.col("exactness"))
    hits = hits.withColumn("_best", F.min("_rank").over(Window.partitionBy("find_id"))).where("_rank = _best")
    plain = ~F.col("typology").contains(",")
    score = F.coalesce((F.col("_wc") == F.col("name_ware.code")).cast("int"), F.lit(0)) + F.coalesce((F.col("form_code") == F.col("name_form.code")).cast("int"), F.lit(0))
    regional = F.coalesce(F.contains(F.lower("typology"), region_of(F.col("_full"))), F.lit(False))
    entry = F.struct(F.col("code"), F.col("label"), F.col("ware_label"), F.col("form_code"), F.col("_wc").alias("ware_code"))
    chosen = hits.groupBy("find_id").agg(
        F.min(F.when(plain, F.struct(-score, "position", entry.alias("e"))))["e"].alias("_plain"), F.count_if(regional).alias("_n_region"), F.max(F.when(regional, entry)).alias("_region"),
        F.count("*").alias("_n"), F.max(entry).alias("_only"),
    )
    term = F.coalesce("_plain", F.when(F.col("_n_region") == 1, F.col("_region")), F.when(F.col("_n") == 1, F.col("_only")))
    rows = finds.join(chosen.select("find_id", term.alias("term")), "find_id", "left")

    listed = master.select(F.lower(F.trim("typology")).alias("_mt"), F.lower("ware").alias("_mw"), F.lower("form").alias("_mf")).groupBy("_mt").agg(F.min(F.struct("_mw", "_mf")).alias("_m")).select("_mt", "_m.*")
    by_alias = lambda v, out: v.select(F.explode(F.split(F.coalesce("aliases", F.lit("")), r"\|")).alias("_a"), F.struct("code", "label").alias(out)).select(F.lower(F.trim("_a")).alias(f"_{out}_key"), out).where(f"_{out}_key <> ''").groupBy(f"_{out}_key").agg(F.min(out).alias(out))
    by_code = lambda v, out: v.select(F.col("code").alias(f"_{out}_key"), F.struct("code", "label").alias(out))
    rows = rows.join(listed, F.lower(F.trim("typology")) == F.col("_mt"), "left")
    for vocabulary, key_column, out, how in ((wares, "_mw", "master_ware", by_alias), (forms, "_mf", "master_form", by_alias), (wares, "term.ware_code", "term_ware", by_code), (forms, "term.form_code", "term_form", by_code)):
        rows = rows.join(how(vocabulary, out), F.col(key_column) == F.col(f"_{out}_key"), "left").drop(f"_{out}_key")

    def guarded(name: str, found: str) -> Column:
        refines = F.contains(F.lower(F.col(f"{found}.label")), F.lower(F.col(f"{name}.label")))
        other = F.col(name).isNotNull() & F.col(found).isNotNull() & (F.col(f"{name}.code") != F.col(f"{found}.code")) & ~refines
        return F.when(other, F.col(name)).otherwise(F.col(found))

    has_term = F.col("term").isNotNull()
    ware = F.when(has_term, F.coalesce("term_ware", "master_ware", "any_ware")).otherwise(F.coalesce(F.col("master_ware"), guarded("name_ware", "any_ware")))
    form = F.coalesce(F.col("master_form"), guarded("name_form", "any_form"))
    unsafe = F.coalesce(form["code"].isin(*NAME_ONLY_FORMS) & (F.coalesce(F.col("name_form.code"), F.lit("")) != form["code"]), F.lit(False))
    rows = rows.withColumns({"ware": ware, "form": F.when(has_term, F.col("term_form")).otherwise(F.when(~unsafe, form))})
    pair = combined.where("coalesce(typology, '') = '' and not contains(ware_label, ',')").select(tx.spaced_alnum(F.col("ware_label")).alias("_pw"), F.col("form_code").alias("_pf"), F.struct("code", "label").alias("pair")).groupBy("_pw", "_pf").agg(F.min("pair").alias("pair"))
    rows = rows.join(pair, (tx.spaced_alnum(F.split("ware.label", ",")[0]) == F.col("_pw")) & (F.col("form.code") == F.col("_pf")) & ~has_term, "left")
    code, label = F.coalesce("term.code", "pair.code"), F.coalesce("term.label", "pair.label")
    any_code = F.coalesce("ware.code", "form.code", code)
    return rows.select("find_id", F.when(any_code.isNotNull(), F.lit(style)).alias("std_vocabulary"), F.col("ware.code").alias("std_ware_code"), F.col("ware.label").alias("std_ware_label"), F.col("form.code").alias("std_form_code"), F.col("form.label").alias("std_form_label"), code.alias("std_combined_code"), label.alias("std_combined_label"))
