"""Corpus operators where labels are rare or files are packed anew."""

import corpus_pipeline as cp
from chronoloom.llm import language_id as li

SF = "/root/testdata/sf0.01"


def test_a_tiny_label_wins_no_text_of_a_large_one(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(60).collect()
    learned = " ".join(" ".join(li.words_of(r.text)) for r in rows[:40])[:20_000]
    for tiny in ("a", "ok", "hello", "hello world", "abcdefghijklmnopqrstuvwxyz", "the quick brown fox jumps over the lazy dog"):
        judge = li.Identifier({"en": f" {learned} ", "xx": f" {tiny} "})
        judged = [judge(r.text) for r in rows[40:] if li.words_of(r.text)]
        assert judged and all(name == "en" and rate < cp.STRANGE for name, _, rate in judged), tiny


def test_near_dedup_keeps_rows_when_files_are_packed_anew(spark, tmp_path):
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(words[(i * 31 + j * (i % 7 + 1)) % 400] for j in range(40)) + f" only{i}") for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(0, 40, 4)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(12).write.parquet(str(tmp_path / "d"))
    want = {r.doc_id for r in cp.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "d")), SF).collect()}
    out = cp.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "d")), SF)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")  # as if other executors were registered now
    try:
        assert sorted(r.doc_id for r in out.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert not want & {i for i, _ in rows if i >= 100}
