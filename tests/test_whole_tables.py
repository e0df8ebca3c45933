"""Registered queries over all rows of small tables, against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import intervals as iv
from chronoloom.operators import matching as mt
from chronoloom.operators import pages as pg
from chronoloom.operators import sections as sc
from chronoloom.operators import summary as sm
from chronoloom.plans import hybrid, registry


def components(nodes, links):
    """The smallest node of each node's component."""
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= (root[a], root[b]) != (low, low)
            root[a] = root[b] = low
    return root


def test_site_components_read_every_name(spark, tmp_path):
    # the chain runs through sizes that are not 1 modulo 25
    names = [("alpha beta", 1), ("beta", 2), ("beta gamma", 3), ("gamma", 26), ("omega", 4)]
    spark.createDataFrame(names, "p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    tokens = {n: set(n.split()) for n, _ in names}
    near = [(a, b) for a in tokens for b in tokens if (c := tokens[a] & tokens[b]) and (c in (tokens[a], tokens[b]) or len(c) / len(tokens[a] | tokens[b]) >= 0.6)]
    got = {r.name: r.component for r in registry.QUERIES["site_components"](spark, str(tmp_path)).collect()}
    assert got == components(tokens, near) and got["gamma"] == "alpha beta" and got["omega"] == "omega"


def test_synonym_components_read_every_order(spark, tmp_path):
    # keys 1, 2 and 998 are not multiples of 9; 1 and 998 name the same code
    orders = [(1, 70), (998, 50), (2, 50), (9, 60), (4, 61)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    links = [(c, o % 997 + 100000) for o, c in orders]
    got = {r.code: r.root for r in registry.QUERIES["synonym_components"](spark, str(tmp_path)).collect()}
    assert got == components({x for link in links for x in link}, links) and got[70] == got[100002] == 50


def test_sampled_band_agrees_with_single_draws(spark, tmp_path):
    """The query's thousand simulations beside 20,000 in which every record is drawn on its own."""
    orders = [(k, k % 7) for k in range(1, 13)] + [(1 + 500 * k, 1) for k in range(1, 300)]  # the latter share one range
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, k % 3) for k in range(7)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    sims, rng = 20_000, np.random.default_rng(5)
    counts = np.zeros((sims, 19))
    for k, c in orders:
        start = k * 37 % 500 - 52
        at = np.floor((start + rng.random(sims) * (1 + c % 200) + 12) / 25).astype(int)
        inside = (at >= 0) & (at < 19)
        np.add.at(counts, (np.flatnonzero(inside), at[inside]), 1)
    got = {r.bin: r for r in registry.QUERIES["mc_sampled_band"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(19))
    for b in range(19):
        n, r = counts[:, b], got[b]
        assert abs(r.mc_mean - n.mean()) <= 5 * n.std() / math.sqrt(1000) + 1e-9
        assert abs(r.mc_sd - n.std()) <= 5 * n.std() / math.sqrt(2000) + 0.02
        assert abs(r.p5 - np.quantile(n, 0.05)) <= 1 + 0.1 * n.std() and abs(r.p95 - np.quantile(n, 0.95)) <= 1 + 0.1 * n.std()


def test_sampled_counts_follow_no_partitioning(spark):
    rows = spark.createDataFrame([(k, k % 40, k % 40 + 1 + k % 90) for k in range(4000)], "id long, start int, end int")
    one, two = ({tuple(r) for r in iv.simulated_counts(x, 50).collect()} for x in (rows.repartition(1), rows.repartition(9, "id")))
    every = {s: sum(n for sim, _, n in one if sim == s) for s in range(50)}
    assert one == two and set(every.values()) == {4000}  # no range leaves the bins: no draw is lost
    assert len({tuple(sorted((b, n) for sim, b, n in one if sim == s)) for s in range(50)}) == 50
    assert {tuple(r) for r in iv.simulated_counts(rows, 50, seed=7).collect()} != one


def test_quotes_of_any_length_are_found(spark):
    body = "Inhumation graves, with a hand-\nformed beaker of Niederbieber type 33 and someoldcoins, were found below the eastern wall (late phase)."
    plain = re.sub("[^a-z0-9]", "", body.lower())
    cuts = [plain[a : a + n] for a in (0, 3, 11, 30, 47) for n in (1, 2, 5, 9, 14, 15, 16, 22, 30, 31, 33, 40, 60)]
    quotes = [*cuts, "beaker", "Niederbieber type", "hand-formed beaker of", "ormed beaker of Niederb", "some old coins were found below", "absent", "wall below", "", "...", body]
    reports = [body, plain[20:70], "nothing of it", "", None]
    norm = lambda t: re.sub("[^a-z0-9]", "", (t or "").lower())
    want = {(i, j) for i, q in enumerate(quotes) for j, r in enumerate(reports) if norm(q) and norm(q)[:40] in norm(r)}
    asked = spark.createDataFrame(list(enumerate(quotes)), "q long, text string")
    got = mt.verified_quotes(asked, spark.createDataFrame(list(enumerate(reports)), "r long, text string"), "q", "r").collect()
    assert sorted((r.q, r.r) for r in got) == sorted(want)


def test_profiles_whose_sums_differ_at_each_reading(spark):
    """The order in which a sum's parts arrive changes its last digits; no site may lose its rank by that."""
    shake = F.udf(lambda: random.random() * 1e-9, "double").asNondeterministic()
    finds = lambda k: spark.range(300).select((F.col("id") % 10).alias("site_id"), (F.col("id") * k % 400).cast("double").alias("start")).select("site_id", (F.col("start") + shake()).alias("start"), (F.col("start") + 60).alias("end"))
    spark.conf.set("spark.sql.exchange.reuse", "false")  # else a small table's sums are made once
    try:
        row = iv.profile_agreement(finds(37), finds(37)).first()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert row.n_sites == 10 and row.pearson > 0.999999 and row.spearman > 0.9 and row.dominant_agreement == 1.0 and row.mean_abs_diff < 1e-6


@pytest.mark.parametrize("searched", [256, 1])
def test_places_across_pages(spark, monkeypatch, searched):
    """The first place of short texts in reports that are read page by page, against whole texts."""
    monkeypatch.setattr(mt, "SEARCHED", searched)
    rng = random.Random(5)
    word = lambda: rng.choice(("pot", "Jug", "a", "bowl-like", "IX", "dish"))
    pages = [(f"r{r}", n, rng.choice((None, "", " \n", " ".join(word() for _ in range(rng.randrange(1, 9))) + rng.choice(("", "\n", " \t"))))) for r in range(3) for n in range(40)]
    frame = spark.createDataFrame(pages, "report_id string, page_number int, text string").repartition(5)
    forms = {"": (lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), lambda t: re.sub("[^a-z0-9]", "", t.lower())), " ": (lambda c: F.lower(F.regexp_replace(c, r"\s+", " ")), lambda t: re.sub(r"\s+", " ", t.lower()).lstrip(" "))}
    for gap, (column, plain) in forms.items():
        whole = {r: plain("\n\n".join(t for q, _, t in pages if q == r and t is not None)) for r in ("r0", "r1", "r2")}
        heads = {(r, t[i : i + n]) for r, t in whole.items() for n in (1, 4, 14, 15, 33, 50) for i in (rng.randrange(len(t)) for _ in range(8))} | {("r0", "never said"), ("r0", ""), ("r9", "pot")}
        heads = {(r, h.lstrip(" ")) for r, h in heads}
        got = mt.first_places(spark.createDataFrame(sorted(heads), "report_id string, h string"), pg.pieces(frame, column, gap, 49), ["report_id"], "h")
        assert {(r.report_id, r.h): r.place for r in got.collect()} == {(r, h): whole[r].find(h) + 1 for r, h in heads if h and r in whole and h in whole[r]}


def test_no_row_of_the_cascade_carries_its_whole_report(spark):
    pages = spark.createDataFrame([("r", 1, "Three pots. A pot,"), ("r", 2, "a  Jug.")], "report_id string, page_number int, text string")
    rows = [("r", "", 0, 2, "three pots.", "pots"), ("r", "", 8, None, "A pot, a jug", "pot"), ("r", "", 8, None, "jug.", "jug"), ("r", "", 0, 3, "pots. a", "many")]
    rows = spark.createDataFrame(rows, "report_id string, site_name string, pot_name_certainty_level int, quantity int, original_text string, term_found string")
    out = hybrid.without_previews(rows, pages)
    assert {r.term_found for r in out.collect()} == {"pot", "jug", "many"}
    assert "array_join" not in out._jdf.queryExecution().toString()


def test_windows_of_sections_of_any_length(spark):
    """Windows made of parts equal those that are cut from whole sections, and no section is put together for them."""
    rng = random.Random(8)
    text = lambda: rng.choice(("x" * rng.randrange(1, 9), "ab cd", "GULPEN.", "GULPEN. rest", " a\tb ", "long " * rng.randrange(1, 30), ""))
    lines = [(r, p, n, text()) for r in ("r", "s", None) for p in range(30) for n in range(rng.randrange(0, 6))] + [("t", 1, 0, "GULPEN."), ("u", 1, 0, "y" * 40), ("v", 1, 0, "y" * 30), ("v", 2, 0, "z" * 9), ("w", 1, 0, "y" * 41)]
    rows = spark.createDataFrame(lines, "report_id string, page int, line_no int, line string")
    keys, order = ["report_id"], ["page", "line_no"]
    marked = sc.mark_headings(rows, keys, order, places=["gulpen"], keywords=["results"], provinces=["utr"])
    want = sc.chunks(sc.sections(marked, keys, order, "page"), size=40, overlap=7, breaks="page_breaks")
    got = sc.section_chunks(marked, keys, order, "page", size=40, overlap=7)
    assert sorted(map(repr, got.select(sorted(got.columns)).collect())) == sorted(map(repr, want.select(sorted(got.columns)).collect())) and got.count() > 60


def test_no_section_is_put_together_for_its_windows(spark):
    query = registry.QUERIES["sectionise_headings"](spark, "/root/testdata/sf0.001")
    assert "_parts" not in query._jdf.queryExecution().toString()


def test_many_chunks_share_a_call(spark):
    """Chunks are paired in batches, also those that lie across two of them; each different text is read once."""
    schema = "chunk int, mention_id int, kind string, position int, start_char int, end_char int, known string, is_form boolean"
    rows = [(c, c * 10 + i, "typology" if i < 2 else "name", i, i * 50, i * 50 + 5, "", False) for c in range(40) for i in range(5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        pairs = sm.pair_names(spark.createDataFrame(rows, schema), ["chunk"])
        assert "FlatMapGroups" not in pairs._jdf.queryExecution().toString()
        assert {(r.mention_id, r.name_id, r.taken) for r in pairs.collect()} == {(c * 10 + k, c * 10 + k + 2, True) for c in range(40) for k in (0, 1)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
