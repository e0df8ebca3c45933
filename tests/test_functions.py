"""Scalar semantics on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import certainty as ct
from chronoloom.functions import cues, replies
from chronoloom.functions import dates as dt
from chronoloom.functions import text as tx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("text, start, end, precision", [
    ("late 2nd century AD", 151, 200, "medium"), ("early 3rd century", 201, 251, "medium"), ("mid 2nd century", 126, 175, "medium"),
    ("1st century BC", -100, -1, "medium"), ("late 1st century BC", -50, -1, "medium"), ("19-16 BC", -19, -16, "high"), ("AD 70-120", 70, 120, "high"),
    ("70 n.Chr.", 70, 70, "high"), ("1st to 3rd century AD", 1, 300, "medium"), ("13de, wellicht 14de eeuw", 1201, 1400, "medium"),
    ("vroeg-4e-eeuws", 301, 351, "medium"), ("eerste eeuwen n.Chr.", 1, 300, "medium"), ("third and fourth centuries AD", 201, 400, "medium"),
    ("midden van de 2e eeuw", 126, 175, "medium"), ("second century BCE", -200, -101, "medium"), ("Late Roman", 276, 450, "low"),
])
def test_date_signals(text, start, end, precision):
    found = dt.SignalGrammar().signals(f"found {text} there")
    assert [(s[1], s[2], s[4]) for s in found] == [(start, end, precision)]


def test_date_signals_edges():
    grammar = dt.SignalGrammar()
    assert grammar.signals(None) == grammar.signals("") == grammar.signals("no date 70") == []
    assert len(grammar.signals("AD 70 and the 2nd century")) == 2


def test_date_signals_column(spark):
    rows = spark.createDataFrame([("AD 70",), (None,)], "t string").select(dt.date_signals(F.col("t")).alias("s")).collect()
    assert [len(r.s) for r in rows] == [1, 0]


@pytest.mark.parametrize("s, e, kept", [(-52, 450, True), (450, 1500, False), (400, 450, True), (None, None, True), (-100, -52, False), (500, None, False)])
def test_scope(spark, s, e, kept):
    row = spark.createDataFrame([(s, e)], "s int, e int")
    assert row.where(dt.in_scope(F.col("s"), F.col("e"))).count() == kept


@pytest.mark.parametrize("s, e, want", [(101, None, (101, 450)), (None, 300, (-12, 300)), (500, None, (500, None)), (None, None, (None, None))])
def test_clamp(spark, s, e, want):
    row = spark.createDataFrame([(s, e)], "s int, e int").select(dt.clamp_one_sided(F.col("s"), F.col("e")).alias("c")).first().c
    assert (row.start, row.end) == want


@pytest.mark.parametrize("vocab, signals, want", [
    ((70, 300), [(101, 200, "medium")], ("combined_narrowed", 101, 200, 0.85)), ((300, 450), [(101, 200, "medium")], ("conflict_flagged", 300, 450, 0.30)),
    ((300, 450), [(70, 70, "high")], ("text_overrides_typology", 70, 70, 0.70)), ((None, None), [(70, 90, "low")], ("text_only", 70, 90, 0.55)),
    ((70, 300), [], ("typological_direct", 70, 300, 0.85)), ((None, None), [], ("unassigned", None, None, 0.0)), ((70, 300), [(80, 90, "low")], ("typological_direct", 70, 300, 0.85)),
])
def test_reconcile(spark, vocab, signals, want):
    schema = "vs int, ve int, signals array<struct<start:int,end:int,precision:string>>"
    d = spark.createDataFrame([(*vocab, signals)], schema).select(dt.reconcile(F.col("vs"), F.col("ve"), F.col("signals"), F.lit(0.85)).alias("d")).first().d
    assert (d.method, d.start, d.end, d.confidence) == want


@pytest.mark.parametrize("text, label, confidence", [
    ("niet aangetroffen", "absent", 0.90), ("vergelijkbaar", "comparison", 0.90), ("cf. Drag 37", "uncertain", 0.30), ("mogelijk", "uncertain", 0.70),
    ("gevonden", "present", 0.85), ("x", "uncertain", 0.30), (None, "uncertain", 0.30), ("Jansen (2007a), pl. 3", "irrelevant", 0.90),
])
def test_classifier(spark, text, label, confidence):
    got = one(spark, cues.classify_context(F.col("t"), F.lit(None).cast("string"), F.lit(2), F.lit(False)), t=text)
    assert (got.label, got.confidence) == (label, confidence)


@pytest.mark.parametrize("raw, want", [
    ("fi\rnd ﬁnd", "fi nd find".replace(" nd", "\nnd", 1)), ("handge-\nvormd", "handge-vormd"), ("schaalt-jes", "schaaltjes"), ("terra-sigillata", "terra sigillata"),
    ("Drag 18", "Drag. 18"), ("from70b A , b", "from70b A, b"), ("fromb70", "from 70"), ("16bBC", "16 BC"), ("page 3\nText here.", "Text here."), ("word .Next", "word. Next"), (None, ""), ("", ""),
])
def test_clean_text(spark, raw, want):
    assert one(spark, tx.clean_text(F.col("t")), t=raw) == want


def test_defragment(spark):
    broken = "\n".join(["word one"] * 12 + list("die") + [" "] + list("kom") + ["tail line"] + ["x y"] * 5)
    assert one(spark, tx.defragment(F.col("t")), t=broken).split("\n")[12:16] == ["die", " ", "kom", "tail line"]
    table = "\n".join(list("123456789012345678901234"))
    assert one(spark, tx.defragment(F.col("t")), t=table) == table


@pytest.mark.parametrize("raw, want", [("onzer jaartelling", "n.Chr."), ("Romeinsche", "Romeinse"), ("mensch", "mens"), ("logisch", "logisch"), ("na Chr.", "n.Chr.")])
def test_modern_spelling(spark, raw, want):
    assert one(spark, tx.modern_spelling(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw, want", [("Drag. 37", "dragendorff 37"), ("Alzey 33 cf.", "alzey 33"), ("Gose type 377", "gose 377"), (None, "")])
def test_typology_form(spark, raw, want):
    assert one(spark, tx.typology_form(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw, want", [("--/95-1-19/10813, Drag. 37", "95-1-19/10813"), ("19-16 BC", None), ("a 1-2-3 b", None), (None, None)])
def test_registration_number(spark, raw, want):
    assert one(spark, tx.registration_number(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw, want", [('a {"x": 1,} b', {"x": 1}), ('{"x": {"y": 2}}}', {"x": {"y": 2}}), ('{"d": 300-100}', {"d": None}), ('{"x": "cut', {"x": "cut"}), ("none", None), (None, None), ('{"a": "b" "c": 1}', {"a": "b", "c": 1})])
def test_repaired_object(raw, want):
    assert replies.repaired_object(raw) == want


@pytest.mark.parametrize("raw, n", [('[{"a":1},{"b":2}]', 2), ('```json\n{"finds":[{"a":1}]}\n```', 1), ('{"finds": [{"a":1}, {"b":', 1), ("", 0), (None, 0), ("[]", 0), ('x [{"a":1},] y', 1)])
def test_whole_objects(raw, n):
    assert len(replies.whole_objects(raw)) == n


def test_rescued_label(spark):
    labels = ("present", "absent")
    assert one(spark, replies.rescued_label(F.col("t"), labels), t='label: "Absent", oops') == "absent"
    assert one(spark, replies.rescued_label(F.col("t"), labels), t="it is present") == "present"
    assert one(spark, replies.rescued_label(F.col("t"), labels), t="no idea") is None


def test_certainty(spark):
    assert one(spark, ct.undiminish(F.lit("Small dish"), F.lit("schaaltjes"))) == "Dish"
    assert one(spark, ct.undiminish(F.lit("Small dish"), F.lit("kom"))) == "Small dish"
    assert one(spark, ct.name_certainty(F.lit(12), F.lit(False), F.lit(True))) == 10
    assert one(spark, ct.name_certainty(F.lit(9), F.lit(True), F.lit(True))) == 4
    assert one(spark, ct.is_tentative(F.lit("cf. Drag. 37")))
