"""Operators on small frames: edge cases, properties, and the figures of published examples."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from chronoloom.operators import intervals as iv
from chronoloom.operators import matching as mt
from chronoloom.operators import names as nm
from chronoloom.operators import pages as pg
from chronoloom.operators import records as rc
from chronoloom.operators import scoring as sg
from chronoloom.operators import sections as sc
from chronoloom.operators import spans as sp
from chronoloom.operators.components import connected_components
from chronoloom.plans import hybrid
from chronoloom.sources import adapters as ad
from chronoloom.sources import readers as rd
from chronoloom.sources import writers as wr
from chronoloom.streaming.incremental import process_new_files

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_aoristic_loses_the_gap(spark):
    row = iv.site_weights(spark.createDataFrame([("a", 1, 100), ("a", 5, 5), ("a", None, 9)], "site_id string, start int, end int")).first()
    assert (row.w_early, row.w_middle, row.w_late) == pytest.approx((69 / 99, 29 / 99, 0))


@QUICK
@given(some.lists(some.tuples(some.integers(-200, 600), some.integers(0, 300)), min_size=1, max_size=20))
def test_weights_stay_within_one(spark, ranges):
    rows = spark.createDataFrame([(i, s, s + n) for i, (s, n) in enumerate(ranges)], "site_id int, start int, end int")
    for row in iv.site_weights(rows).collect():
        assert -1e-9 <= row.w_early + row.w_middle + row.w_late <= 1 + 1e-9
    assert all(r.weight >= 0 for r in iv.binned(rows).collect())


def test_monte_carlo_agrees_with_its_moments(spark):
    rows = spark.createDataFrame([(i, "a", 0, 100) for i in range(200)], "id int, site_id string, start int, end int")
    sampled = {r.bin: r.mc_mean for r in iv.monte_carlo_band(rows, 50).collect()}
    exact = {r.bin: r.weight for r in iv.regional_curve(rows).collect()}
    assert all(abs(sampled[b] - w) < 5 for b, w in exact.items())


@pytest.mark.parametrize("n, starts", [(1200, [0]), (1201, [0, 1050]), (3000, [0, 1050, 2100]), (0, [])])
def test_chunk_starts(spark, n, starts):
    rows = sc.chunks(spark.createDataFrame([("x" * n,)], "text string")).orderBy("chunk_no").collect()
    assert [r.text_offset_start for r in rows] == starts
    assert all(r.is_full_section == (n <= 1200) for r in rows)


@QUICK
@given(some.text(alphabet="ab c.\n", max_size=300))
def test_chunks_cover_the_text(spark, text):
    rows = sc.chunks(spark.createDataFrame([(text,)], "text string"), size=40, overlap=7).collect()
    covered = {i for r in rows for i in range(r.text_offset_start, r.text_offset_start + 40)}
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def test_repeating_lines_thresholds(spark):
    line = "Report of the excavation"
    pages = spark.createDataFrame([("r", i, f"{i} / {line}\nbody {i} of the page here") for i in range(3)] + [("one", 1, line)], "report_id string, page_number int, text string")
    assert [(r.norm, r.n_pages) for r in pg.repeating_lines(pages).collect()] == [(line, 3)]
    cleaned = {(r.report_id, r.page_number): r.text for r in pg.strip_repeating_lines(pages).collect()}
    assert cleaned["r", 1] == "body 1 of the page here" and cleaned["one", 1] == line


def test_marginalia(spark):
    blocks = spark.createDataFrame([("r", 1, "12", 0.0, 5.0, 10.0, 1000.0), ("r", 1, "A long body text of many words", 0.0, 200.0, 800.0, 1000.0)], "report_id string, page_number int, text string, x0 double, y0 double, y1 double, page_height double")
    pages = spark.createDataFrame([("r", 1, "12\nbody 12\n12 left")], "report_id string, page_number int, text string")
    assert pg.strip_marginalia(pages, blocks).first().text == "body 12\n12 left"


def test_sections_and_breaks(spark):
    lines = [("r", 1, 0, "GULPEN. Some text"), ("r", 1, 1, "more text"), ("r", 2, 0, "and more"), ("r", 2, 1, "H E E L."), ("r", 3, 0, "Houten (Utr.). Bij het graven"), ("r", 3, 1, "3"), ("r", 3, 2, "results"), ("r", 3, 3, "4")]
    rows = spark.createDataFrame(lines, "report_id string, page int, line_no int, line string")
    marked = sc.mark_headings(rows, ["report_id"], ["page", "line_no"], places=["gulpen"], keywords=["results"], provinces=["utr"])
    got = sc.sections(marked, ["report_id"], ["page", "line_no"], "page").orderBy("section_no").collect()
    assert [(r.section_no, r.site_name, r.text) for r in got] == [(2, "Gulpen", "Some text\nmore text\nand more"), (4, "Houten", "Bij het graven\n3\nresults\n4")]
    assert [(b.page, b.offset) for b in got[0].page_breaks] == [(1, 0), (2, 20)]
    assert [r.p for r in spark.createDataFrame([got[0]]).select(sc.page_at(F.col("page_breaks"), F.lit(20)).alias("p")).collect()] == [2]


def test_page_packing_always_advances(spark):
    pages = spark.createDataFrame([("r", i, "x" * n) for i, n in enumerate((50, 50, 500, 50, 50))], "report_id string, page_number int, text string")
    got = [(r.page_from, r.page_to) for r in sc.pack_pages(pages, 120).orderBy("window_no").collect()]
    assert got[0] == (0, 1) and got[-1][1] == 4 and all(a[0] < b[0] for a, b in zip(got, got[1:]))


def spans(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "g int, start int, end int")


@QUICK
@given(some.lists(some.tuples(some.integers(0, 12), some.integers(1, 8)), max_size=12), some.lists(some.tuples(some.integers(0, 12), some.integers(1, 8)), max_size=6))
def test_span_algebra_against_brute_force(spark, one, two):
    one, two = [(s, s + n) for s, n in one], [(s, s + n) for s, n in two]
    got = sorted((r.start, r.end) for r in sp.drop_contained(spans(spark, *one), ["g"]).collect()) if one else []
    assert got == sorted(a for a in one if not any(b[0] <= a[0] and b[1] >= a[1] and b[1] - b[0] > a[1] - a[0] for b in one))
    free = sorted((r.start, r.end) for r in sp.not_covered(spans(spark, *one), spans(spark, *two), ["g"]).collect())
    assert free == sorted(a for a in one if not any(b[0] <= a[0] and b[1] >= a[1] for b in two))


def test_matches_have_their_offsets(spark):
    row = spark.createDataFrame([("ab é ab",), ("none",), (None,)], "t string").select(sp.matches_of(F.col("t"), "ab").alias("m")).collect()
    assert [(m.start, m.end) for m in row[0].m] == [(0, 2), (5, 7)] and row[1].m is None and row[2].m is None


def test_components_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 5), (9, 8), (8, 9), (None, 4)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 8: 8, 9: 8}
    assert connected_components(edges.where("false")).count() == 0


@QUICK
@given(some.lists(some.tuples(some.integers(0, 14), some.integers(0, 14)), min_size=1, max_size=20))
def test_components_against_union_find(spark, pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}


def test_long_chain(spark):
    chain = spark.range(200).selectExpr("id as src", "id + 1 as dst")
    assert {r.component for r in connected_components(chain).collect()} == {0}


def test_site_clusters(spark):
    rows = spark.createDataFrame([(n,) for n in ("Heerlen", "Heerlen, Tempsplein", "Tempsplein", "Voerendaal", "Heerlen, Tempsplein", "", None)], "name string")
    got = {r.name: r.canonical for r in nm.canonical_names(rows).collect()}
    assert got == {"Heerlen": "Heerlen, Tempsplein", "Heerlen, Tempsplein": "Heerlen, Tempsplein", "Tempsplein": "Heerlen, Tempsplein", "Voerendaal": "Voerendaal"}


def test_ancestor_of_a_cycle_is_null(spark):
    nodes = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", False)], "node string, ok boolean")
    parents = spark.createDataFrame([("a", "b"), ("b", "a"), ("d", "c"), ("d", "x")], "node string, parent string")
    assert {r.node: r.ancestor for r in nm.first_ancestor(nodes, parents, "ok").collect()} == {"a": None, "b": None, "c": "c", "d": "c"}


def finds(spark, rows):
    return spark.createDataFrame(rows, "report_id string, id long, typ string, key string, family string, toks array<string>, start int, end int")


def test_greedy_linkage_tiers(spark):
    gold = finds(spark, [("r", 1, "d37", "bowl", "ts", ["bowl"], 100, 200), ("r", 2, "", "dish", "ts", ["dish"], None, None), ("r", 3, "", "jar", "x", ["red", "jar"], 1, 2), ("r", 4, "", "cup", "", [], 1, 2)])
    out = finds(spark, [("r", 1, "d37", "a", "", [], 90, 200), ("r", 2, "d37", "b", "", [], 100, 200), ("r", 3, "", "dish", "", [], None, None), ("r", 4, "", "zz", "", ["jar"], 1, 2), ("s", 9, "", "", "", [], None, None)])
    got = {(r.report_id, r.gold_id, r.output_id, r.tier) for r in mt.link_greedily(gold, out).collect()}
    assert got == {("r", 1, 2, 1), ("r", 2, 3, 2), ("r", 3, 4, 4), ("r", 4, None, 0), ("r", None, 1, 0), ("s", None, 9, 0)}


@QUICK
@given(some.lists(some.sampled_from("abc"), max_size=8), some.lists(some.sampled_from("abc"), max_size=8))
def test_linkage_is_one_to_one(spark, one, two):
    row = lambda side: finds(spark, [("r", i, t, t, "", [], 1, 2) for i, t in enumerate(side)])
    got = mt.link_greedily(row(one), row(two)).collect()
    assert sorted(r.gold_id for r in got if r.gold_id is not None) == list(range(len(one)))
    assert sorted(r.output_id for r in got if r.output_id is not None) == list(range(len(two)))


@pytest.mark.parametrize("gold, found, typed, want", [(100, 120, False, "acceptable"), (100, 120, True, "incorrect"), (100, 100, True, "exact"), (None, None, False, "exact"), (None, 1, False, "incorrect")])
def test_endpoint_verdict(spark, gold, found, typed, want):
    row = spark.createDataFrame([(gold, found, typed)], "g int, f int, t boolean")
    assert row.select(sg.endpoint_verdict(F.col("g"), F.col("f"), F.col("t")).alias("v")).first().v == want


def test_longest_keyword(spark):
    texts = spark.createDataFrame([(1, "Drie bekers en een terra-sigillata kom"), (2, "standbeeld"), (3, ""), (4, None), (5, "de kom")], "i int, text string")
    words = spark.createDataFrame([("beker",), ("Beeld",), ("terra sigillata",), ("kom",), ("",), (None,)], "keyword string")
    assert {r.i: r.keyword for r in mt.longest_keyword(texts, words, ["i"]).collect()} == {1: "terra sigillata", 5: "kom"}
    assert mt.longest_keyword(texts, words.where("false"), ["i"]).count() == 0


def test_dedup_is_idempotent(spark):
    rows = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (2, 1, "c")], "k int, pos int, v string")
    once = sp.first_by_position(rows, ["k"], ["pos"])
    assert sorted(r.v for r in once.collect()) == sorted(r.v for r in sp.first_by_position(once, ["k"], ["pos"]).collect()) == ["b", "c"]


def test_validation_names_what_is_missing(spark):
    schema = "record_id string, report_id string, term_raw string, term_canonical string, context_label string, context_confidence double, chrono_start int, chrono_end int, chrono_status string, chrono_confidence double, match_type string, interpretation_method string, page int"
    rows = [(None, "", "x", "", None, None, 300, None, "assigned", None, "", "llm", None), ("a", "r", "x", "T", "present", 0.123456, None, None, "skipped", None, "regex", None, 1), ("b", "r", "x", "T", "odd", 0.5, None, 9, "", 0.25, None, None, 1)]
    bad, good, third = rc.validate(rc.nested(spark.createDataFrame(rows, schema))).collect()
    assert not bad.validation.valid and bad.validation.issues == ["missing: record_id", "missing: report_id", "missing: term.canonical", "missing: context.label", "missing: context.confidence",
                                                                  "missing: chronology range", "missing: chronology.end", "missing: confidence of context and chronology", "missing: evidence.page"]
    assert good.validation.valid and good.confidence.composite == 0.0741 and good.metadata.detection_method == "regex" and not good.metadata.fallback_applied
    assert bad.confidence.composite is None and bad.metadata.fallback_applied and bad.metadata.detection_method == "unknown" and bad.sites[0].site_name is None
    assert third.validation.issues == ["missing: chronology.status", "missing: chronology range", "missing: chronology.start"] and third.confidence.composite == 0.4


def test_overall_rounds_half_to_even(spark):
    assert spark.range(1).select(rc.overall_certainty([F.lit(2), F.lit(3), F.lit(None).cast("int")]).alias("x")).first().x == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "report_id string, page_number int, text string")
    assert pg.clean_pages(none).count() == sc.chunks(none).count() == sc.pack_pages(none, 10).count() == pg.repeating_lines(none).count() == 0


def test_readers_and_writers(spark, tmp_path):
    gold = tmp_path / "old_rep_1.csv"
    gold.write_text("﻿Page,Site_name,Pot_name,Typology,,Start_date,End_date,Original_text\n3, Heel ,Dish,Drag. 37,,100,ca 200,quote\n,,Bowl,,,,,\n", encoding="utf-8")
    rows = rd.read_finds(spark, str(gold), rd.GOLD_COLUMNS).orderBy("id").collect()
    assert [(r.report_id, r.pot, r.typ, r.start, r.end, r.site, r.page) for r in rows] == [("old_rep_1", "Dish", "dragendorff 37", 100, None, "heel", 3), ("old_rep_1", "Bowl", "", None, None, None, None)]
    with pytest.raises(ValueError, match="Absent"):
        rd.read_table(spark, str(gold), ["Absent"])
    summary = spark.createDataFrame([("r1", "dish", 5), ("r2", "bowl", None)], "report_id string, pottery string, start_date int")
    wr.write_summary(summary, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert len(back.columns) == 20 and back.count() == 2
    (tmp_path / "t.nq").write_text('<a> <p> "x\\"y"@en <g> .\n<a> <q> <b> .\n# note\n')
    assert {(r.s, r.p, r.o) for r in rd.read_triples(spark, str(tmp_path / "t.nq")).collect()} == {("a", "p", 'x\\"y'), ("a", "q", "b")}


def test_layout_and_grids(spark):
    reply = '{"pages":[{"blocks":[{"boundingBox":{"vertices":[{"x":1,"y":2},{"x":9,"y":4}]},"paragraphs":[{"words":[{"symbols":[{"text":"a"},{"text":"b"}]},{"symbols":[{"text":"c"}]}]}]}]}]}'
    block = spark.createDataFrame([(reply,)], "r string").select(rd.layout_blocks(F.col("r")).alias("b")).first().b[0]
    assert (block.text, block.x0, block.y0, block.x1, block.y1) == ("ab c", 1, 2, 9, 4)
    grid = spark.createDataFrame([("[[p3 table 1]] |a|b| [[p4 table 2]] |c|",)], "t string").select(rd.tagged_grids(F.col("t")).alias("g")).first().g
    assert [(g.page, g.table_no, g.grid) for g in grid] == [(3, 1, "|a|b|"), (4, 2, "|c|")]


class Busy:
    def __init__(self, fails):
        self.fails = fails

    def answer(self, prompts):
        if self.fails:
            self.fails -= 1
            raise ad.Transient
        return ["ok" for _ in prompts]


def test_retries_and_adapters(spark):
    busy, pauses = Busy(2), []
    assert ad.with_retries(lambda: busy.answer(["x"]), sleep=pauses.append) == ["ok"] and pauses == [2.0, 4.0]
    with pytest.raises(ad.Transient):
        ad.with_retries(lambda: Busy(99).answer(["x"]), sleep=pauses.append)
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "p string")
    got = [r.reply for r in ad.ask(rows, "p", ad.StubModel({"a": "A"})).orderBy("p").collect()]
    assert got == [None, "A", "A", None]
    files = spark.createDataFrame([("x/rep_1.txt", bytearray(b"one\x0ctwo")), ("x/bad.txt", None)], "path string, content binary")
    pages = ad.read_pages(files, ad.PlainPages()).orderBy("report_id", "page_number").collect()
    assert [(p.report_id, p.page_number, p.text) for p in pages][1:] == [("rep_1", 1, "one"), ("rep_1", 2, "two")] and pages[0].error


def test_site_chain(spark):
    rows = spark.createDataFrame([("r", "Heerlen"), ("r", None), ("s", "Stein, kasteel"), ("t", "Stein")], "report_id string, site_name string")
    got = sorted((r.report_id, r.site_name) for r in hybrid.site_chain(rows).collect())
    assert got[0] == got[1] == ("r", "Heerlen")


def test_reports_in_their_order_and_appended_columns(spark, tmp_path):
    for name in ("ocr_2", "old_rep_10", "old_rep-9", "zeta", "alpha_1", "new_rep_1", "table_3"):
        (tmp_path / f"{name}.pdf").write_bytes(b"x")
    got = [(r.report_id, r.bucket, r.number) for r in rd.list_reports(spark, str(tmp_path)).collect()]
    assert got == [("old_rep-9", "old_rep", 9), ("old_rep_10", "old_rep", 10), ("table_3", "table", 3), ("ocr_2", "ocr", 2), ("new_rep_1", "new_rep", 1), ("alpha_1", "alpha", 1), ("zeta", "zeta", 0)]
    out = tmp_path / "out.csv"
    out.write_text("pottery,typology,start_date,end_date,original_text,term_found_normalized_en,context_label\nJar,,500,600,a,jar,present\nCup,,,,a medieval cup,cup,\nPan,,,,Roman to medieval,pan,\nLid,T 1,50,,medieval,lid,absent\nDish,,,,in text,iron age dish,\n")
    names = lambda **how: [r.pot for r in rd.read_finds(spark, str(out), rd.OUTPUT_COLUMNS, **how).orderBy("id").collect()]
    assert names() == ["Jar", "Cup", "Pan", "Lid", "Dish"] and names(window=(-52, 450)) == ["Pan", "Lid"] and names(present_only=True, window=(-52, 450)) == ["Pan"]
    table = rd.read_table(spark, str(out)).select("pottery", "typology")
    found = spark.createDataFrame([("Jar", "T 9", "X"), ("Cup", None, "Y")], "pottery string, typology string, std string")
    wr.append_columns(table, found, "pottery", str(out), str(tmp_path / "more"))
    assert sorted((r.pottery, r.typology, r["std"]) for r in rd.read_table(spark, str(tmp_path / "more")).collect())[:2] == [("Cup", None, "Y"), ("Dish", None, None)]
    with pytest.raises(ValueError, match="being read"):
        wr.append_columns(table, found, "pottery", str(out), f"{out}/")


def test_hybrid_cascade(spark):
    page = ("Opgraving te Heel, Drag. 37 bakje en drie potten. Een pot, nog een kruik, een pot. Zie -27/3/5 en een kom cf. Stuart 9 uit de Midden tijd. Dolium, middeleeuws. "
            "Amphora Drag. 99/Stuart 9 en een urn.")
    pages = spark.createDataFrame([("r", 1, page), ("c", 1, "Veldprospectie\n123456\nDe beker stond hier.\n654321\nEen deksel en een urn.\n777777\nOok een urn."), ("e", 1, "Title\nFig. 1 Stein")], "report_id string, page_number int, text string")
    finds = [dict(pottery="Small dish", typology="Drag. 37", term_found="bakje", quote="Drag. 37 bakje", certainty=8, presence=9, site_name="Heel"), dict(pottery="Pots", term_found="drie potten", quote="drie potten.", certainty=8, specific=False, quantity=3, site_name="Heel"),
             dict(pottery="Pot", term_found="pot", quote="Een pot, nog", certainty=7, site_name="Heel"), dict(pottery="Jug", term_found="kruik", quote="een kruik, een", certainty=7, site_name="Heel"), dict(pottery="Pot", term_found="pot", quote="een pot. Zie", certainty=7, site_name="Heel, dorp"),
             dict(pottery="Bowl", typology="cf. Stuart 9", quote="kom cf. Stuart 9", certainty=9, site_name="Heel"), dict(pottery="Vat", quote="uit de Midden tijd", site_name="Heel", quantity=0), dict(pottery="Dolium, medieval", quote="Dolium, middeleeuws"),
             dict(pottery="Amphora", typology="Drag. 99/Stuart 9", quote="Amphora Drag. 99"), dict(pottery="Ghost", quote="never said"), dict(pottery=" ", quote="Opgraving te Heel")]
    beakers = [dict(pottery="Beaker", quote="De beker stond hier.", start_date=50, site_name="Elsewhere"), dict(pottery="Urn", quote="een urn"), dict(pottery="Late", quote="Een deksel", start_date=600, end_date=700)]
    model = ad.StubModel({hybrid.CONFIRM + "Lid": '{"present": true, "confidence": 0.84}', hybrid.CONFIRM: '{"present": true, "confidence": 0.5}', hybrid.SITE: 'It is {"site": "Stein"}', "Opgraving": json.dumps({"finds": finds}), "Veld": json.dumps(beakers),
                          "Title": json.dumps([dict(pottery="Fibula pot", quote="Title", certainty=3)])}, default="[]")
    index = spark.createDataFrame([("DRAGENDORFF_37", "Dragendorff 37", 60, 260, "Dish"), ("STUART_9", "Stuart 9", 100, 150, None)], "key string, code string, date_start int, date_end int, name string")
    rules = [("r", 1, "Jug", None, "x", "present"), ("r", 2, "Jug", None, "y", "present"), ("c", 3, "Lid", "Stuart 9", "Een deksel", "present"), ("c", 4, "Lid", None, "z", "absent"), ("r", 5, "Cup", None, "nr -27/3/5", "present"), ("r", 6, "Cup", "T", "nr 27/3/5", None)]
    rules = spark.createDataFrame([(a, b, "", c, d, None, None, e, f) for a, b, c, d, e, f in rules], "report_id string, position int, site_name string, pottery string, typology string, start_date int, end_date int, original_text string, context_label string")
    rows = hybrid.hybrid_cascade(pages, rules, index, model, gazetteer=[(["Midden tijd"], 10, 90)]).collect()
    got = {(r.report_id, r.pottery, r.original_text): r for r in rows}
    assert len(rows) == len(got) and {(r, p) for r, p, _ in got} == {("r", p) for p in ("Dish", "Pot", "Jug", "Bowl", "Vat", "Amphora", "Cup")} | {("c", "Beaker"), ("c", "Urn"), ("c", "Lid"), ("e", "Fibula pot")}
    one = lambda name: next(r for r in rows if r.pottery == name)
    levels = lambda r: (r.pot_name_certainty_level, r.pot_presence_certainty_level, r.dates_certainty_level, r.overall_certainty_level)
    assert (one("Dish").typology, one("Dish").start_date, one("Dish").date_method, levels(one("Dish"))) == ("Dragendorff 37", 60, "model+typology", (8, 9, 8, 8))
    assert (one("Bowl").typology, one("Bowl").end_date, levels(one("Bowl"))) == ("Stuart 9 cf.", 150, (4, None, 4, 4))
    assert (one("Amphora").typology, one("Amphora").start_date) == ("Dragendorff. 99/Stuart 9", 100)
    assert (one("Vat").start_date, one("Vat").date_method, one("Vat").dates_certainty_level, one("Vat").quantity, one("Vat").pot_name_certainty_level) == (10, "period_term", 8, None, None)
    assert (one("Beaker").end_date, one("Beaker").date_method, one("Beaker").dates_certainty_level, one("Beaker").site_name) == (450, "context_clamp", 3, "123456")
    assert (one("Lid").typology, one("Lid").date_method, levels(one("Lid")), one("Lid").site_name) == ("Stuart 9", "rules+model_confirmed", (8, 8, 8, 8), "654321")
    assert (one("Cup").original_text, one("Cup").date_method, levels(one("Cup"))) == ("nr -27/3/5", "rules+model", (6, 7, 0, 4))
    assert one("Fibula pot").site_name == "Stein" and {r.site_name for r in rows if r.report_id == "r"} == {"Heel"} and one("Urn").site_name == "Elsewhere"


def test_stream_of_new_files(spark, tmp_path):
    schema = "report_id string, page_number int, text string"
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    for n in (1, 2):
        spark.createDataFrame([(f"r{n}", 1, "a  b")], schema).write.mode("append").parquet(source)
        process_new_files(spark, source, schema, pg.clean_pages, target, checkpoint).awaitTermination()
    assert sorted((r.report_id, r.text) for r in spark.read.parquet(target).collect()) == [("r1", "a b"), ("r2", "a b")]
