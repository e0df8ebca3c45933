"""Rows of finds from mentions: pairing by brute force, the row builder's rules, the cascade's last steps."""

import random

from pyspark.sql import functions as F

from chronoloom.functions import periods as pd
from chronoloom.operators import matching as mt
from chronoloom.operators import names as nm
from chronoloom.operators import records as rc
from chronoloom.operators import summary as sm


def choose(rows):
    """Codes take the nearest name that is still there, one after the other."""
    names, out = [r for r in rows if r["kind"] == "name"], {}
    for code in (r for r in rows if r["kind"] == "typology"):
        best, least = None, 121
        for name in names:
            gap = name["start_char"] - code["end_char"] if code["end_char"] <= name["start_char"] else max(0, code["start_char"] - name["end_char"])
            if gap < least:
                best, least = name, gap
        if best:
            out[code["mention_id"]] = (best["mention_id"], not code["known"] or best["is_form"])
            if out[code["mention_id"]][1]:
                names.remove(best)
    return out


def test_codes_choose_names_in_turn(spark):
    rng = random.Random(6)
    rows = []
    for chunk in range(60):
        for i in range(rng.randrange(0, 14)):
            start = rng.randrange(0, 900)
            rows.append({"report": f"r{chunk % 7}", "chunk": chunk, "mention_id": len(rows), "kind": rng.choice(("typology", "name", "name", "generic")), "position": i, "start_char": start, "end_char": start + rng.randrange(1, 20), "known": rng.choice(("", "known")), "is_form": rng.random() < 0.3})
    frame = spark.createDataFrame(rows, "report string, chunk int, mention_id long, kind string, position int, start_char int, end_char int, known string, is_form boolean")
    got = {r.mention_id: (r.name_id, r.taken) for r in sm.pair_names(frame.repartition(5), ["report", "chunk"]).collect()}
    want = {}
    for chunk in range(60):
        want |= choose([r for r in rows if r["chunk"] == chunk])
    assert got == want and len(want) > 50
    assert sm.pair_names(frame.where("false"), ["report", "chunk"]).count() == 0


def test_rows_of_finds(spark):
    schema = "chunk int, mention_id int, kind string, position int, start_char int, end_char int, known string, label string, is_form boolean, typology string, date struct<start:int,end:int,method:string>, context_label string, context_confidence double, sentence string, term string"
    typology, century, period = (70, 120, "typology"), (101, 200, "text_century"), (1, 400, "chron_vocab")
    rows = [
        (1, 1, "typology", 1, 0, 9, "", "code", False, "T 1", typology, "present", 0.85, "", "T 1"), (1, 2, "name", 2, 20, 30, "", "bowl", True, None, century, "present", 0.85, "", "bowl"),
        (2, 3, "typology", 1, 0, 9, "samian", "code", False, "T 2", typology, "present", 0.9, "", "T 2"), (2, 4, "name", 2, 20, 30, "", "coarse ware", False, None, period, "present", None, "", "ware"),
        (3, 5, "typology", 1, 0, 9, "", "code", False, "T 3", None, "present", 0.3, "", "T 3"), (3, 6, "name", 2, 20, 30, "", "jar", False, None, period, "present", 0.3, "", "jar"),
        (4, 7, "typology", 1, 0, 9, "", "Pottery", False, "T 4", None, "present", 0.5, "a Plate of form T 4", "T\n 4"), (4, 8, "name", 2, 300, 310, "", "far", False, None, None, "present", 0.5, "", "far"),
        (5, 9, "typology", 1, 0, 9, "", "code", False, "T 5", None, "present", 0.5, "--/89-0-0/8128, T 5 (Fig. 2)", "T 5"), (5, 10, "generic", 2, 12, 15, "", "beker", True, None, century, "present", 0.5, "", "beker"),
        (6, 11, "typology", 1, 0, 9, "", "code", False, "T 6", None, "present", 0.5, "Drag. 37, T 6", "T 6"),
    ]
    got = {r.mention_id: r for r in sm.build_rows(spark.createDataFrame(rows, schema), ["chunk"]).collect()}
    assert sorted(got) == [1, 3, 4, 5, 7, 8, 9, 10, 11]  # 2 and 6 were taken
    shown = {i: (r.pottery, r.typology, r.start_date, r.end_date, r.date_method) for i, r in got.items()}
    assert shown[1] == ("bowl", "T 1", 101, 200, "text_century")  # the name's text dates the find
    assert shown[3] == ("samian", "T 2", 70, 120, "typology") and shown[4][0] == "coarse ware"  # a period only fills gaps
    assert shown[5] == ("jar", "T 3", 1, 400, "chron_vocab")
    assert shown[7][0] == "plate" and got[7].term_found == "T 4" and shown[9][0] == "--/89-0-0/8128"
    assert shown[10] == ("beker", None, None, None, None) and shown[11][0] == "code"
    assert (got[1].pot_name_certainty_level, got[1].pot_presence_certainty_level, got[1].dates_certainty_level) == (8, 9, 9) and got[4].pot_presence_certainty_level is None


def test_cascade_clamps_drops_and_names_sites(spark):
    schema = "report_id string, chunk_no int, start_char int, site_name string, page int, pottery string, typology string, is_generic boolean, is_tabular boolean, has_marker boolean, start_date int, end_date int, date_method string, original_text string, pot_name_certainty_level int, pot_presence_certainty_level int, dates_certainty_level int, overall_certainty_level int"
    rows = [
        ("r", 1, 1, "Heerlen", 1, "jar", None, False, False, False, 101, None, "text_century", "a", 6, 8, 9, 8), ("r", 1, 2, "Heerlen, Tempsplein", 1, "cup", "T 1", False, False, False, 70, 120, "typology", "b", 8, 8, 8, 8),
        ("r", 1, 3, "Heerlen, Tempsplein", 1, "mug", None, False, False, False, 70, 120, "typology", "see pp. 12-14", 6, 8, 8, 7), ("r", 1, 4, "Voerendaal", 1, "lid", "T 9", False, False, False, 70, 120, "typology", "pp. 3", 8, 8, 8, 8),
        ("r", 1, 5, "Voerendaal", 1, "pan", None, False, False, False, 500, 600, "text_century", "c", 6, 8, 9, 8),
    ]
    got = {r.pottery: r for r in rc.summary_cascade(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"jar", "cup", "lid"}
    assert (got["jar"].start_date, got["jar"].end_date, got["jar"].date_method, got["jar"].dates_certainty_level, got["jar"].overall_certainty_level) == (101, 450, "context_clamp", 3, 6)
    assert {got["jar"].site_name, got["cup"].site_name} == {"Heerlen, Tempsplein"} and got["lid"].site_name == "Voerendaal"


def test_cascade_drops_echoes_within_a_report(spark):
    schema = "report_id string, chunk_no int, start_char int, site_name string, page int, pottery string, typology string, is_generic boolean, is_cell boolean, is_tabular boolean, has_marker boolean, start_date int, end_date int, date_method string, original_text string"
    row = lambda report, at, name, typ=None, general=False, cell=False, tab=False, mark=False, dates=(1, 99), text=None, site="A", page=1: (report, 1, at, site, page, name, typ, general, cell, tab, mark, *dates, "typology", f"text {at}" if text is None else text)
    rows = [
        row("r", 1, "Jar", text="a"), row("r", 1, "jar", text="b"),  # one position
        row("r", 2, "27-3/5", text="c"), row("r", 3, "27-3/5", text="d"), row("r", 4, "27-3/5", site="B"), row("r", 5, "cup"), row("r", 6, "cup"),  # numbers are unique finds, names are not
        row("r", 7, "bowl", "T 1", text="same"), row("r", 8, "Bowl", text="same"), row("r", 9, "bowl", text="other"), row("s", 8, "bowl", text="same"),
        row("r", 10, "pan"), row("r", 11, "Pan", general=True), row("r", 12, "pan", general=True, site="C"), row("r", 13, "pan", general=True, cell=True), row("r", 14, "pan", "T 2", general=True),
        row("r", 15, "x", "T 3", tab=True, page=2), row("r", 16, "y", "t 3", mark=True, page=2), row("r", 17, "x", "T 3", mark=True, page=3), row("r", 18, "x", "T 3", page=2),
        row("r", 19, "pot", dates=(None, None), text="medieval"), row("r", 20, "pot", dates=(None, None), text="Roman to medieval"), row("r", 21, "pot", dates=(100, None), text="medieval"),
        row("r", 22, "lid", text="see p. 4"), row("r", 23, "lid", text="pp. 4"), row("r", 24, "lid", "T 4", text="pp. 4"),
    ]
    got = sorted((r.report_id, r.start_char) for r in rc.summary_rows(spark.createDataFrame(rows, schema)).collect())
    assert got == [("r", k) for k in (1, 2, 4, 5, 6, 7, 9, 10, 12, 13, 14, 15, 17, 18, 20, 21, 22, 24)] + [("s", 8)]


def test_sites_are_named_within_a_report(spark):
    rows = [("r", "Heerlen"), ("r", "Heerlen, Tempsplein"), ("s", "Heerlen, Coriovallum"), ("t", "Stein"), ("t", "Stein, kasteel"), ("u", "Stein, kasteel")]
    frame = spark.createDataFrame(rows, "report string, site string")
    assert {(r.report, r.name): r.canonical for r in nm.canonical_names(frame, "site", "report").collect()} == {
        ("r", "Heerlen"): "Heerlen, Tempsplein", ("r", "Heerlen, Tempsplein"): "Heerlen, Tempsplein", ("s", "Heerlen, Coriovallum"): "Heerlen, Coriovallum",
        ("t", "Stein"): "Stein, kasteel", ("t", "Stein, kasteel"): "Stein, kasteel", ("u", "Stein, kasteel"): "Stein, kasteel"}
    assert {(r.report, r.collapsed) for r in nm.collapse_compounds(frame, "site", "report").collect()} == {("r", "Heerlen"), ("s", "Heerlen, Coriovallum"), ("t", "Stein"), ("u", "Stein, kasteel")}


def test_named_periods(spark):
    vocabulary = [("Romeinse tijd", -12, 450), ("Volle Middeleeuwen", 1000, 1250), ("Claudische tijd", 41, 54), ("Middeleeuwen", 450, 1500)]
    cases = {"uit de Romeinse tijd t/m Volle Middeleeuwen": (-12, 1250), "CLAUDISCH of Claudisch tijdvak": None, "een Claudische tijdvak in de Romeinse tijd": (41, 54), "Middeleeuwen tot Romeinse tijd": (-12, 450), "": None, None: None, "Romeinse tijden": None}
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = [None if r.f is None else tuple(r.f) for r in frame.select("i", pd.named_period(F.col("t"), vocabulary).alias("f")).orderBy("i").collect()]
    assert got == list(cases.values())


def test_one_letter_and_long_keywords(spark):
    words = ["a", "alpha", "alpha be", "alpha beta gam", "beta", "b c", "z", "...", ""]
    texts = ["alpha beta gamma", "Alpha-Bet", "so b cat", "xa", "", None, "bravo: a", "beta"]
    got = {r.i: r.keyword for r in mt.longest_keyword(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), spark.createDataFrame([(w,) for w in words], "keyword string"), ["i"]).collect()}
    assert got == {0: "alpha beta gam", 1: "alpha be", 2: "b c", 6: "a", 7: "beta"}
