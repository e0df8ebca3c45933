"""Encoding, counting and their edge cases against the public libraries."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoloom.llm import bpe, queries, token_count
from chronoloom.llm.pieces import BYTE_LEVEL

RANKS, VOCABULARY = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "Ünïcödé — ﬁn\n\n\t x", "a" * 3000, "=-" * 900, "<|endoftext|>", "x <|endoftext|>y<|endoftext|><|endoftext|>", "don't we'll 12345 ...!!", "漢字かな🙂🙂", "x" * 255 + " " + "é" * 200, "".join(random.Random(1).choices("abcdef0123456789+/", k=9000))]


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as file:
        return bpe.Codec(bpe.Vocabulary.from_tiktoken(file.read()))


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def counter():
    with open(VOCABULARY, "rb") as file:
        return token_count.Counter(file.read())


def test_pattern():
    assert BYTE_LEVEL == P.PATTERN


@settings(max_examples=150, deadline=None)
@given(some.text(max_size=120))
def test_encoding_equals_the_library(codec, library, text):
    ids = codec.encode(text).tolist()
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", TEXTS)
def test_encoding_of_odd_texts(codec, library, text):
    assert codec.encode(text).tolist() == library.encode_ordinary(text or "")


def test_single_and_batched_tables_agree(codec):
    pieces = [p.encode() for p in codec.split(" ".join(t for t in TEXTS if t)) if len(p.encode()) < 300]
    import numpy as np

    for piece, ids in zip(pieces, codec.table.encode(pieces)):
        assert np.frombuffer(ids, np.int32).tolist() == bpe.PrefixTable(codec.vocabulary, piece).ids() == codec.vocabulary.merge(piece)


@settings(max_examples=60, deadline=None)
@given(some.binary(max_size=60), some.lists(some.tuples(some.integers(0, 60), some.integers(0, 5), some.binary(max_size=6)), max_size=5))
def test_appends_and_edits_are_exact(codec, data, edits):
    table = bpe.PrefixTable(codec.vocabulary, data)
    for start, cut, new in edits:
        start = min(start, len(table.data))
        table.splice(start, min(len(table.data), start + cut), new)
        assert table.last == bpe.PrefixTable(codec.vocabulary, table.data).last
        assert table.ids() == codec.vocabulary.merge(table.data)


def test_an_edit_stays_local(codec):
    table = bpe.PrefixTable(codec.vocabulary, b"the quick brown fox " * 300)
    assert table.splice(100, 101, b"x") < 400


def test_encode_query_columns(spark):
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)] + [(None, "x", "null id"), (0, None, "again")], "doc_id long, text string, ids string")
    out = bpe.decode_documents(bpe.encode_documents(docs, RANKS), RANKS)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in out.collect())
    digest = spark.createDataFrame([([],), ([5, 17],)], "ids array<int>").select(bpe.ids_digest(F.col("ids")).alias("d")).collect()
    assert digest[0].d == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855" and digest[1].d == spark.sql("select sha2('5 17', 256) d").first().d
    assert bpe.encode_documents(docs.where("false"), RANKS).count() == 0


@settings(max_examples=150, deadline=None)
@given(some.lists(some.text(max_size=60), max_size=6))
def test_counts_equal_the_library(counter, texts):
    library = Tokenizer.from_file(VOCABULARY)
    assert counter(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_of_odd_texts(spark, counter):
    library = Tokenizer.from_file(VOCABULARY)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    assert counter(TEXTS) == want
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    rows = token_count.count_tokens(docs, VOCABULARY, limit=3).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == want and [r.over_limit for r in rows] == [n > 3 for n in want]
    assert [r.n_bytes for r in rows] == [len((t or "").encode()) for t in TEXTS]
    assert token_count.count_tokens(docs.where("false"), VOCABULARY).count() == 0


def test_op1_and_op9_over_a_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    import hashlib

    for r in queries.op1_byte_bpe(spark, sf).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    hf = Tokenizer.from_file(VOCABULARY)
    assert all(r.n_tokens == len(hf.encode(texts[r.doc_id], add_special_tokens=False).ids) for r in queries.op9_token_counts(spark, sf).collect())
