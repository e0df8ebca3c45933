"""Trigger mentions, predicates and confirmation on small inputs."""

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import predicates as pr
from chronoloom.operators import triggers as tr
from chronoloom.plans import hybrid
from chronoloom.sources import adapters as ad
from chronoloom.sources import readers as rd

LEXICON = tr.Lexicon(
    triggers=("terra sigillata", "aardewerk", "beker", "kom", "onbekend", "jugs"),
    naming=(r"\b(Drag\.?\s+\d+)\b", r"(?i)\b((?:glad|ruw)wandig\s+aardewerk)\b", r"(?i)\b(terra\s+sigillata)\b"),
    vessels=("bowl", "jug", "kom", "beker"), indicator=r"(?i)\b(?:aardewerk|sigillata|drag|dolia)\b",
)


def names(spark, text):
    rows = spark.createDataFrame([("r", 1, 0, 0, text)], "report_id string, section_no int, chunk_no int, text_offset_start int, chunk_text string")
    return [(r.abs_start, r.name) for r in tr.mentions(rows, LEXICON).orderBy("abs_start").collect()]


@pytest.mark.parametrize("text, want", [
    ("Er lag ruwwandig aardewerk in de kuil", ["ruwwandig aardewerk"]), ("Veel aardewerkfragmenten daar", ["aardewerk"]), ("een kom van terra sigillata", ["Kom"]),
    ("In de kuil lag een beker", []), ("x\nbeker?\ny z", ["beker"]), ("onbekend onbekend onbekend", []), ("Function\nbeker\n3", []),
    ("dolia and jugs were there with aardewerk", ["jugs", "aardewerk"]), ("", []), (None, []), ("terra\nsigillata", ["terra\nsigillata"]),
])
def test_mentions(spark, text, want):
    assert [n for _, n in names(spark, text)] == want


def test_contexts_of_mentions(spark):
    text = "508067\nIntro of it.\nMUNTEN: een munt van 54. Van Nero.\nAARDEWERK: Er lag aardewerk uit de 2e eeuw, en verder. One here. Two here. Three here. Four here. Five here.\nGLAS. Scherven."
    at = text.index("aardewerk")
    schema = "report_id string, section_no int, chunk_no int, text_offset_start int, is_full_section boolean, page_breaks array<struct<page:int,offset:int>>, section_text string, chunk_text string"
    rows = [("r", 1, 0, 0, True, [(3, 0), (4, 30)], text, text), ("r", 2, 0, 9, False, [(3, 0)], "123456\nx\n" + "x" * 20, text[7:]), ("r", 3, 0, 0, False, None, None, "7\naardewerk 2e eeuw\n1"), ("r", 4, 0, 0, None, None, "", "")]
    one, two, three = tr.mentions(spark.createDataFrame(rows, schema), LEXICON).where("term = 'aardewerk'").orderBy("section_no").collect()
    assert one.start == at and one.page == 4 and one.site_code == "508067" and one.clause_date_context == "aardewerk uit de 2e eeuw" and one.line_date_context == ""
    assert one.date_context.startswith("508067\nIntro of it.\n") and "AARDEWERK: Er lag" in one.date_context and "Nero" not in one.date_context and "GLAS" not in one.date_context
    assert one.forward_date_context == text[at:].strip() and two.site_code == "123456"
    assert two.date_context.endswith("Two here.") and two.date_context.startswith("MUNTEN")
    assert (three.line_date_context, three.site_code, three.page) == ("aardewerk 2e eeuw", "", None)


def test_windows_count_once_and_known_spans_are_left(spark):
    rows = spark.createDataFrame([("r", 1, 0, 0, "xx aardewerk yy"), ("r", 1, 1, 3, "aardewerk yy")], "report_id string, section_no int, chunk_no int, text_offset_start int, chunk_text string")
    assert tr.mentions(rows, LEXICON).count() == 1
    known = spark.createDataFrame([("r", 1, n, s, s + 9) for n, s in ((0, 3), (1, 0))], "report_id string, section_no int, chunk_no int, start int, end int")
    assert tr.mentions(rows, LEXICON, known).count() == 0


@pytest.mark.parametrize("name, valid", [("1985", False), ("[aardewerk]", False), ("ware", False), ("Late Roman coarse ware", False), ("bronze aardewerk", False), ("bowl", False), ("grijs aardewerk", True), (None, False)])
def test_valid_names(spark, name, valid):
    assert spark.createDataFrame([(name,)], "n string").select(tr.is_valid_name(F.col("n"), LEXICON).alias("v")).first().v == valid


def test_predicates(spark):
    row = spark.createDataFrame([(None, "Drag 18/31", "Brunsting 9/Stuart 211", " Aardewerk ")], "a string, b string, c string, d string")
    got = row.select(pr.canonical_hint(F.col("a")).alias("h"), pr.slash_kind(F.col("b")).alias("k"), pr.slash_parts(F.col("c")).alias("p"), pr.ware_bucket(F.col("d")).alias("w"), pr.same(F.col("a"), F.lit(None)).alias("s"), pr.out_of_scope_label(F.lit("medieval bowl"), "medieval", "roman").alias("o")).first()
    assert (got.h, got.k, got.p, got.w, got.s, got.o) == ("UNMAPPED", "variants", ["Brunsting 9", "Stuart 211"], "generic", True, True)
    assert row.select(pr.family(F.lit("grey Samian dish"), F.lit(""), {"samian": "ts"}, {"grey": "grey"}, {}).alias("f")).first().f == "ts"
    text = "One. Two is here. Three " + "x" * 700 + ". Four."
    assert len(spark.range(1).select(pr.forward_context(F.lit(text), F.lit(0), 2).alias("c")).first().c) == 650


def test_confirmed_surplus(spark):
    finds = spark.createDataFrame([("r", "dish", "Dish", "q")], "report_id string, ware string, pottery string, original_text string")
    rules = spark.createDataFrame([("r", "dish", "Dish", "q", 1), ("r", "dish", "Dish", "yes", 2), ("r", "jug", "Jug", "no", 3)], "report_id string, ware string, pottery string, original_text string, position int")
    model = ad.StubModel({"Dish": '{"present": true, "confidence": 0.9}'}, default='{"present": true, "confidence": 0.5}')
    got = hybrid.confirm_merge(finds, rules, model, ["position"]).collect()
    assert sorted((r.pottery, r.date_method) for r in got if r.date_method) == [("Dish", "rules+model_confirmed")]


def test_first_folder(spark, tmp_path):
    assert rd.first_folder(spark, str(tmp_path / "none"), str(tmp_path)) == str(tmp_path)
    with pytest.raises(FileNotFoundError, match="none"):
        rd.first_folder(spark, str(tmp_path / "none"))
