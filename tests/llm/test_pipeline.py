"""The registered queries beside their SQL, and the pipeline's stages on planted rows."""

import glob
import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline as cp
from chronoloom.llm import queries
from oracle_check import rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(cursor.fetchall(), columns)


def planted(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"{a}{b}{c}" for a in ("the", "on", "in", "er") for b in ("an", "or", "es") for c in ("ly", "ing", "ed", "at")]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    clean = [(i, "\n".join(prose(30) for _ in range(5))) for i in range(60)]
    copy = clean[0][1].split(" ")
    copy[20] = "changed"
    passage = "\n".join(prose(25) for _ in range(4))
    rows = [*clean, (100, clean[1][1]), (101, " ".join(copy).replace("\n", " ")), (102, f"{prose(60)} {item} {prose(60)}"), (103, "12 345 ... !!"), (104, None), (105, ""), (106, f"{prose(40)}\n{passage}\n{prose(40)}"), (107, f"{prose(50)}\n{passage}\n{prose(50)}")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_on_planted_rows(spark, tmp_path):
    docs, seen = planted(spark), {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        if name != cp.STAGES[-1][0]:
            assert out.columns == cp.COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not {103, 104, 105} & set(seen["language id"]) and set(range(60)) <= set(seen["language id"])
    assert 100 not in seen["line dedup"] and len(seen["line dedup"][106].split("\n")) == 6 and len(seen["line dedup"][107].split("\n")) == 2
    assert 101 not in seen["near dedup"] and set(range(60)) <= set(seen["near dedup"])
    assert 102 not in seen["decontamination"] and {*range(60), 106, 107} == set(seen["decontamination"])
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in docs.collect())


def test_run_over_documents_and_over_nothing(spark, tmp_path):
    assert cp.run(spark, SF).count() > 100
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_of_repeated_rows_and_ids(spark, tmp_path):
    one, two = "the same words in every copy of it here", "quite other words stand in this text now"
    rows = [(1, one), (1, one), (2, one), (2, two), (None, two), (3, None), (3, None), (4, ""), (None, "alone with these few words of mine")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "d"))
    kept = cp.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "d")), SF).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in kept), key=key) == sorted([(1, one), (2, two), (3, None), (3, None), (4, ""), (None, "alone with these few words of mine")], key=key)
