"""A corpus pipeline over ``documents``: language, lines, near duplicates, benchmark, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from chronoloom.shared import forget, materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language needs more phrases per character resembles no language that
#: was learned: its longest matches average under one and a half characters.
STRANGE = 0.7


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that resemble no learned language, go."""
    judged = language_id.predict_languages(docs)
    return judged.where((F.col("lang_pred") != "und") & (F.col("phrase_rate") < STRANGE)).select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line passages are cut; documents that lose all text go."""
    cut = line_dedup.drop_repeated_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.length(F.trim("text")) == 0)
    size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", size).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest id.

    Rows are dropped by number, which keeps one of several rows with equal ids too. The
    numbers are written with the rows: a second scan of the same files may pack them
    otherwise and would number other rows.
    """
    numbered = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    gone = near_dedup.near_duplicate_classes(numbered, carry=("_row",)).where(~F.col("kept")).select("_row")
    return numbered.join(gone, "_row", "left_anti").select(COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that holds a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_leaks(docs, benchmark).where(F.size("leaks") == 0).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether the ids decode to the text."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.decode_documents(bpe.encode_documents(docs, ranks), ranks)
    whole = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return decoded.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"), whole.alias("round_trip"))


STAGES = [
    ("language id", keep_known_languages), ("line dedup", drop_repeated_lines), ("near dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks), ("byte-level bpe", encode),
]
#: Languages, signatures and tokens are beyond SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = last = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, last, sf_dir), name.replace(" ", "_"))
        if name != STAGES[0][0]:
            forget(last)
        last = docs
    return docs
