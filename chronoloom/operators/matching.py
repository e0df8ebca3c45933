"""Joins between vocabularies, quotes and records, and one-to-one record linkage.

Theta joins are given an equality that they imply (a shared token, a shared group, a shared
bin) before the exact condition is tested. Vocabularies are joined as DataFrames; whether
they are broadcast is the planner's decision by their size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dates import OPEN
from ..shared import forget, materialise

#: So many different short texts at most are searched for one by one.
SEARCHED = 256


def abbreviation_index(vocabulary: DataFrame, code: str = "code", abbreviations: str = "abbreviations", order: str = "position") -> DataFrame:
    """(key, code, …): canonical codes (the last row wins) and abbreviations (the first wins, never over a code)."""
    rows = vocabulary.withColumn("_keys", F.array_distinct(F.split(F.coalesce(abbreviations, F.lit("")), r"\|")))
    own = rows.select("*", tx.canonical_code(F.col(code)).alias("key"), F.lit(0).alias("_prio"), (-F.col(order)).alias("_order"))
    short = rows.select("*", F.explode("_keys").alias("_k")).select("*", tx.canonical_code(F.col("_k")).alias("key"), F.lit(1).alias("_prio"), F.col(order).alias("_order")).drop("_k")
    both = own.unionByName(short).where("key <> ''")
    first = F.row_number().over(Window.partitionBy("key").orderBy("_prio", "_order"))
    return both.withColumn("_n", first).where("_n = 1").drop("_n", "_prio", "_order", "_keys")


def lookup_first(rows: DataFrame, index: DataFrame, keys: list[Column], value: str, out: str) -> DataFrame:
    """``rows`` with the value of the first key that the index knows."""
    found = []
    for i, key in enumerate(keys):
        side = index.select(F.col("key").alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        rows = rows.join(side, key == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    return rows.withColumn(out, F.coalesce(*found)).drop(*[c for i in range(len(keys)) for c in (f"_k{i}", f"_v{i}")])


def lookup_parts(rows: DataFrame, index: DataFrame, parts: str, value: str, out: str) -> DataFrame:
    """``rows`` with the value of the first of an array of keys that the index knows, and all parts known of each."""
    different = rows.select(parts).where(F.size(parts) > 0).distinct()
    side = index.select(F.col("key").alias("_k"), F.col(value).alias("_v"))
    known = different.select(parts, F.posexplode(parts).alias("_at", "_key")).join(side, F.col("_key") == F.col("_k"))
    first = known.groupBy(parts).agg(F.min_by("_v", "_at").alias(out))
    return rows.join(first, parts, "left")


def longest_keyword(texts: DataFrame, keywords: DataFrame, key: list[str], text: str = "text", keyword: str = "keyword") -> DataFrame:
    """Per text the longest keyword that starts at a word, whatever follows it; ties by keyword.

    Both sides are reduced to lower-cased words. A text gives its distinct runs of as many
    words as the longest keyword has. A keyword of several words meets the runs that begin with
    its whole words but the last; one of a single word meets those that begin with its letters,
    so nothing but matches meets. Which lengths there are is read first. Texts do not travel.
    """
    word = r"[\p{L}\p{N}]+"
    wanted = keywords.select(F.col(keyword).alias("keyword"), F.regexp_extract_all(F.lower(keyword), F.lit(word), F.lit(0)).alias("_w")).where("size(_w) > 0")
    wanted = wanted.select("keyword", F.array_join("_w", " ").alias("_norm"), F.size("_w").alias("_n"), F.array_join(F.expr("slice(_w, 1, size(_w) - 1)"), " ").alias("_whole"))
    shapes = wanted.select(F.when(F.col("_n") > 1, F.col("_n")).alias("n"), F.when(F.col("_n") == 1, F.length("_norm")).alias("letters")).distinct().collect()  # lengths only
    several, letters = sorted(r.n for r in shapes if r.n), sorted(r.letters for r in shapes if r.letters)
    words = max([1, *several])
    rows = texts.select(*key, F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0)).alias("_w"))
    shifted = F.arrays_zip(*[F.slice("_w", k + 1, F.greatest(F.lit(0), F.size("_w") - k)).alias(f"w{k}") for k in range(words)])
    runs = F.array_distinct(F.transform(shifted, lambda z: F.concat_ws(" ", *[z[f"w{k}"] for k in range(words)])))
    runs = rows.where("size(_w) > 0").withColumn("_runs", runs).select(*key, F.explode("_runs").alias("_run"))
    meets = [F.concat(F.lit(f"{n} "), F.substring_index("_run", " ", n - 1)) for n in several] + [F.when(F.length("_run") >= n, F.concat(F.lit("1 "), F.left("_run", F.lit(n)))) for n in letters]
    runs = runs.select(*key, "_run", F.explode(F.array_compact(F.array(F.lit(None).cast("string"), *meets))).alias("_key"))
    own = F.when(F.col("_n") > 1, F.concat_ws(" ", F.col("_n").cast("string"), "_whole")).otherwise(F.concat(F.lit("1 "), F.col("_norm")))
    found = runs.join(wanted.select("keyword", "_norm", own.alias("_key")), "_key").where(F.startswith("_run", "_norm"))
    return found.groupBy(*key).agg(F.max(F.struct(F.length("keyword").alias("n"), F.lower("keyword").alias("k"))).alias("_b")).select(*key, F.col("_b.k").alias("keyword"))


def _holding(asked: DataFrame, held: DataFrame, on: list[str], ids: list[str], holders: list[str], widths: tuple[int, ...]) -> DataFrame:
    """(on, ids, holders, _head, _t) where a short text ``_head`` stands in a long one ``_t`` with equal ``on`` columns.

    A long text is cut into blocks of a width; 2 * width - 1 characters that stand in it cover
    a whole block, wherever they start, so a short text asks for its first ``width`` runs of
    that width, and only pairs that meet are compared. Texts too short for the smallest width
    are looked up whole among the long text's runs of their lengths. Which lengths there are is
    read first, and only what they need is cut.
    """
    size, least = F.length("_head"), 2 * min(widths) - 1
    sizes = sorted(r.n for r in asked.select(size.alias("n")).distinct().collect() if r.n)
    short = [n for n in sizes if n < least]
    used = sorted({max(w for w in widths if n >= 2 * w - 1) for n in sizes if n >= least})
    runs = lambda w: F.array(*[F.substring("_head", k + 1, w) for k in range(w)])
    own = F.when(size < least, F.array("_head"))
    for w in sorted(widths, reverse=True):
        own = own.when(size >= 2 * w - 1, runs(w))
    asked = asked.select(*on, *ids, "_head", F.explode(own).alias("_key"))
    # cut by expressions that read the text once each: no function looks up a place in it
    cut = lambda w, k: F.regexp_extract_all(F.substring("_t", k + 1, 2**31 - 1), F.lit(f"(?s).{{{w}}}"), F.lit(0))
    keys = F.array_distinct(F.concat(F.array().cast("array<string>"), *[cut(w, 0) for w in used], *[cut(n, k) for n in short for k in range(n)]))
    pairs = held.where("_t <> ''").select(*on, *holders, F.explode(keys).alias("_key")).join(asked, [*on, "_key"])
    pairs = pairs.select(*on, *holders, *ids, "_head").distinct()
    return pairs.join(held.select(*on, *holders, "_t"), [*on, *holders]).where(F.contains("_t", "_head"))


def verified_quotes(quotes: DataFrame, reports: DataFrame, quote_id: str, report_id: str, quote: str = "text", text: str = "text", prefix: int = 40, widths: tuple[int, ...] = (8, 16)) -> DataFrame:
    """(quote_id, report_id) where the normalised quote, or its first characters, stands in the report.

    Both sides are reduced to letters and digits and meet on runs of them.
    """
    asked = quotes.select(F.col(quote_id), F.left(tx.only_alnum(F.col(quote)), F.lit(prefix)).alias("_head")).where("_head <> ''")
    held = reports.select(F.col(report_id), tx.only_alnum(F.col(text)).alias("_t"))
    return _holding(asked, held, [], [quote_id], [report_id], widths).select(quote_id, report_id)


def first_places(heads: DataFrame, pieces: DataFrame, on: list[str], head: str, at: str = "at", text: str = "t", widths: tuple[int, ...] = (8, 16)) -> DataFrame:
    """(on, head, place): where short texts first stand, from 1, in long ones that lie in pieces.

    A piece begins ``at`` characters after its text's beginning and goes on into the next ones
    far enough for a short text that begins in it. Each short text is looked up once, however
    many rows ask for it; texts too long for memory are never put together.
    """
    asked = materialise(heads.select(*on, F.col(head).alias("_head")).where("_head <> ''").distinct(), "heads")
    held = materialise(pieces.select(*on, at, F.col(text).alias("_t")), "pieces")
    # a few short texts are searched for in each piece, which is less work than to cut it into all runs of their lengths
    few = asked.where(F.length("_head") < 2 * min(widths) - 1).groupBy(*on).agg(F.collect_list("_head").alias("_few")).where(F.size("_few") <= SEARCHED)
    seen = F.transform("_few", lambda h: F.struct(h.alias("_head"), F.instr(F.col("_t"), h).alias("_in")))
    met = held.join(few, on).select(*on, at, F.inline(F.filter(seen, lambda x: x["_in"] > 0)))
    rest = asked.join(few.select(*on, F.explode("_few").alias("_head")), [*on, "_head"], "left_anti")
    if not rest.isEmpty():
        met = met.unionByName(_holding(rest, held, on, [], [at], widths).select(*on, at, "_head", F.instr(F.col("_t"), F.col("_head")).alias("_in")))
    found = met.groupBy(*on, F.col("_head").alias(head)).agg(F.min(F.col(at) + F.col("_in")).alias("place"))
    places = materialise(found, "places")
    forget(asked, held)
    return places


def nearest_pairs(left: DataFrame, right: DataFrame, group: list[str], most: int = 120) -> DataFrame:
    """For each left position the nearest right one of its group within ``most`` characters.

    Both sides have ``at`` and an id; candidates meet in bins as wide as the distance, so a
    position sees its own bin and the two beside it. Ties go to the smaller position.
    """
    a = left.withColumn("_bin", F.explode(F.array(*[F.floor(F.col("at") / most) + k for k in (-1, 0, 1)])))
    b = right.select(*group, F.col("at").alias("_at"), F.col("id").alias("near_id"), F.floor(F.col("at") / most).alias("_bin"))
    both = a.join(b, [*group, "_bin"]).withColumn("distance", F.abs(F.col("at") - F.col("_at"))).where(F.col("distance") <= most)
    best = F.min_by(F.struct("near_id", "distance"), F.struct("distance", "_at", "near_id"))
    return both.groupBy(*group, "id", "at").agg(best.alias("_b")).select(*group, "id", "at", "_b.near_id", "_b.distance")


def surplus(rule: DataFrame, model: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Bag difference: of each key the first ``n_rule - n_model`` rule rows."""
    counts = model.groupBy(*keys).agg(F.count("*").alias("_m"))
    place = Window.partitionBy(*keys)
    rows = rule.withColumns({"_rn": F.row_number().over(place.orderBy(*order)), "_n": F.count("*").over(place)})
    return rows.join(counts, keys, "left").where(F.col("_rn") <= F.col("_n") - F.coalesce("_m", F.lit(0))).drop("_rn", "_n", "_m")


def keyed_union(one: DataFrame, two: DataFrame, key: str, better: list[Column], group: tuple[str, ...] = ()) -> DataFrame:
    """Upsert: of rows with equal keys the best stays, of equals the one from ``one``; null keys all pass."""
    both = one.withColumn("_src", F.lit(0)).unionByName(two.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(*group, key).orderBy(*better, "_src"))
    named = both.where(F.col(key).isNotNull()).withColumn("_n", first).where("_n = 1").drop("_n")
    return named.unionByName(both.where(F.col(key).isNull())).drop("_src")


def unique_owner(quotes: DataFrame, blocks: DataFrame, quote_id: str, report: str, quote: str, block: str, owner: str, prefix: int = 60) -> DataFrame:
    """(quote_id, owner) where exactly one block of the report holds the quote; else its first characters decide."""
    # a block that holds the quote holds its first characters too; they meet on runs of characters
    asked = quotes.where(F.length(quote) > 0).select(F.col(report), F.col(quote_id), F.col(quote).alias("_q"), F.left(F.col(quote), F.lit(prefix)).alias("_head"))
    held = blocks.groupBy(report, owner, block).agg(F.count("*").alias("_times")).select(F.col(report), F.col(owner), F.xxhash64(block).alias("_no"), F.col(block).alias("_t"), "_times")
    pairs = _holding(asked, held, [report], [quote_id, "_q"], [owner, "_no", "_times"], (8, 16))
    pairs = pairs.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).withColumns({"_whole": F.contains("_t", "_q"), "_head": F.lit(True)})
    agg = pairs.groupBy(quote_id).agg(*[f(c).alias(f"{n}{c}") for c in ("_whole", "_head") for n, f in (("n", F.count_if), ("o", lambda c: F.max(F.when(F.col(c), F.col(owner)))))])
    whole, head = F.col("n_whole"), F.col("n_head")
    return agg.withColumn(owner, F.when(whole == 1, F.col("o_whole")).when((whole == 0) & (head == 1), F.col("o_head"))).where(F.col(owner).isNotNull()).select(quote_id, owner)


def date_score(gs: Column, ge: Column, ps: Column, pe: Column) -> Column:
    """A struct that sorts by exact ends, overlap, then nearness."""
    exact = F.when(gs == ps, 1).otherwise(0) + F.when(ge == pe, 1).otherwise(0)
    undated_g, undated_p = gs.isNull() & ge.isNull(), ps.isNull() & pe.isNull()
    low, high = F.lit(-9999), F.lit(9999)
    meets = (F.coalesce(ps, low) <= F.coalesce(ge, high)) & (F.coalesce(gs, low) <= F.coalesce(pe, high))
    overlap = F.when(undated_g, 1).when(undated_p, 0).otherwise(meets.cast("int"))
    return F.struct(exact.alias("exact"), overlap.alias("overlap"), (-F.coalesce(F.abs(gs - ps) + F.abs(ge - pe), F.lit(0))).alias("nearness"))


def link_by_rank(gold: DataFrame, output: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One-to-one pairs of equal keys, the k-th of one side with the k-th of the other; full outer.

    The relaxation of the greedy linkage that SQL can state: within a key it pairs as many rows
    as the greedy one, but by order instead of by best date.
    """
    place = lambda df: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    g = gold.withColumn("_k", place(gold)).select(*keys, "_k", F.struct(*[c for c in gold.columns if c not in keys]).alias("gold"))
    p = output.withColumn("_k", place(output)).select(*keys, "_k", F.struct(*[c for c in output.columns if c not in keys]).alias("output"))
    return g.join(p, [*keys, "_k"], "full_outer").drop("_k")


def link_greedily(gold: DataFrame, output: DataFrame, report: str = "report_id", least: float = 0.34) -> DataFrame:
    """(report, gold_id, output_id, tier): one-to-one linkage in four tiers, each consuming what it pairs.

    1 equal typology, 2 equal name key, 3 equal family, 4 token similarity of ``least`` or more.
    Within a tier the best date wins, the first of equals. Unpaired rows have a null side.
    Rows need id, typ, key, family, toks (array), start, end. Which row is left for a later find
    depends on all earlier ones, so a report is linked in one task; only these columns go there.
    """
    import pandas as pd

    columns = [report, "id", "typ", "key", "family", "toks", "start", "end"]
    missing = float("nan")

    def value(x):
        return None if x is None or x != x else x

    def score(g, p):
        gs, ge, ps, pe = (value(v) for v in (g.start, g.end, p.start, p.end))
        exact = int(gs is not None and gs == ps) + int(ge is not None and ge == pe)
        if gs is None and ge is None:
            meets = 1
        elif ps is None and pe is None:
            meets = 0
        else:
            lo, hi = (lambda v: -9999 if v is None else v), (lambda v: 9999 if v is None else v)
            meets = int(lo(ps) <= hi(ge) and lo(gs) <= hi(pe))
        known = None not in (gs, ge, ps, pe)
        return exact, meets, -(abs(gs - ps) + abs(ge - pe)) if known else 0

    def similarity(a, b):
        a, b = set(a if a is not None else ()), set(b if b is not None else ())
        return len(a & b) / len(a | b) if a and b else 0.0

    def link(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        gold_rows, free = list(left.sort_values("id").itertuples()), {r.id: r for r in right.sort_values("id").itertuples()}
        pairs = []
        for tier, field in enumerate(("typ", "key", "family"), 1):
            by: dict[str, dict] = {}
            for r in free.values():
                if getattr(r, field):
                    by.setdefault(getattr(r, field), {})[r.id] = r
            rest = []
            for g in gold_rows:
                same = by.get(getattr(g, field)) if getattr(g, field) else None
                if same:
                    best = max(same.values(), key=lambda p: score(g, p))
                    del same[best.id], free[best.id]
                    pairs.append((g.id, best.id, tier))
                else:
                    rest.append(g)
            gold_rows = rest
        for g in gold_rows:
            best = max(free.values(), key=lambda p: similarity(g.toks, p.toks), default=None)
            if best is not None and similarity(g.toks, best.toks) >= least:
                del free[best.id]
                pairs.append((g.id, best.id, 4))
            else:
                pairs.append((g.id, missing, 0))
        pairs += [(missing, p, 0) for p in free]
        name = left[report].iloc[0] if len(left) else right[report].iloc[0]
        out = pd.DataFrame(pairs, columns=["gold_id", "output_id", "tier"])
        out.insert(0, report, name)
        return out.astype({"gold_id": "Int64", "output_id": "Int64"})

    kind = dict(gold.dtypes)[report]
    return gold.select(columns).groupBy(report).cogroup(output.select(columns).groupBy(report)).applyInPandas(link, f"{report} {kind}, gold_id long, output_id long, tier int")


def without_twins(rows: DataFrame, keys: list, is_specific: Column, stays: Column | None = None) -> DataFrame:
    """A general row goes if a specific one with the same keys exists; rows that ``stays`` holds for do not."""
    kept = is_specific if stays is None else is_specific | stays
    return rows.withColumn("_any", F.max(is_specific).over(Window.partitionBy(*keys))).where(kept | ~F.col("_any")).drop("_any")


def without_subsumed(rows: DataFrame, group: list[str], name: str, typed: Column, shared: Column) -> DataFrame:
    """An untyped row goes if its name is, or is part of, a typed row's name over the same text."""
    own = F.lower(F.coalesce(name, F.lit("")))
    rows = rows.withColumns({"_shared": F.coalesce(shared, F.lit("")), "_own": own})
    typed_rows = rows.where(typed).select(*group, "_shared", F.col("_own").alias("_typed_name")).distinct()
    on = [rows[c].eqNullSafe(typed_rows[c]) for c in group] + [rows["_shared"] == typed_rows["_shared"]]
    return rows.join(typed_rows, reduce(Column.__and__, on) & F.contains("_typed_name", "_own") & ~typed, "left_anti").drop("_shared", "_own")


def overlay(base: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Override rows replace what they state; override rows without a base row are added."""
    over = overrides.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(over, base[key] == F.col("_key"), "full_outer")
    return joined.select(F.coalesce(F.col(key), F.col("_key")).alias(key), *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def in_open_range(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Overlap of a possibly open range with a closed one."""
    return (F.coalesce(start, F.lit(-OPEN)) <= high) & (F.coalesce(end, F.lit(OPEN)) >= low)
