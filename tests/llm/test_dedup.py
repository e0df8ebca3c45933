"""Line dedup, near duplicates and embeddings against brute force, with odd rows."""

import math
from collections import Counter

import numpy as np
import pytest

from chronoloom.llm import embedding_dedup as ed
from chronoloom.llm import line_dedup as ld
from chronoloom.llm import near_dedup as nd


def brute_lines(docs, size=3):
    """Later occurrences of windows, by (id, position)."""
    seen, out = {}, {}
    places = sorted((i, k) for i, t in docs.items() if t is not None for k in range(len(t.split("\n")) - size + 1))
    lines = {i: t.split("\n") for i, t in docs.items() if t is not None}
    covered = {}
    for i, k in places:
        window = tuple(x.strip(" ") for x in lines[i][k : k + size])
        if any(window):
            if window in seen:
                covered.setdefault(i, set()).update(range(k, k + size))
            seen.setdefault(window, (i, k))
    for i, t in docs.items():
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(lines[i]) if k not in covered.get(i, ()))
    return out


def test_line_dedup_against_brute_force(spark):
    docs = {1: "a\nb\nc\nd", 2: "x\na\n b \nc\nd\ny", 3: "a\nb", 4: None, 5: "", 6: "\n\n\n\n", 7: "z\nz\nz\nz\nz", 8: "0\n11\n22\n33", 9: "q\n0\n11\n22", 10: "1\n1\n2\n2", 11: "0\n 1\n2\n2", 12: "\n".join(f"line {i % 50}" for i in range(400))}
    rows = spark.createDataFrame([(i, t, 7) for i, t in docs.items()], "doc_id long, text string, covered int")
    out = ld.drop_repeated_lines(rows)
    assert {r.doc_id: r.text for r in out.collect()} == brute_lines(docs)
    assert out.columns == ["doc_id", "text", "covered", "n_removed"]
    assert ld.drop_repeated_lines(rows.where("false")).count() == 0


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    rows = spark.createDataFrame([(None, "p\nq\nr"), (1, "p\nq\nr"), (1, "p\nq\nr"), (2, "p\nq\nr"), (2, "k\nl\nm")], "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in ld.drop_repeated_lines(rows).collect())
    # the null id stands first; equal rows are treated alike
    assert got == {(None, "p\nq\nr"): 1, (1, ""): 2, (2, ""): 1, (2, "k\nl\nm"): 1}


def words(rng, n):
    return [f"w{rng.integers(5000)}" for _ in range(n)]


def near_classes(texts):
    """Classes by the weighted Jaccard similarity of multisets of word tuples, in plain Python."""
    bags = {}
    for i, t in texts.items():
        found = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        bags[i] = Counter(tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))) if found else Counter()
    df, n = Counter(s for bag in bags.values() for s in bag), sum(map(bool, bags.values()))
    idf = {s: 1 + math.log(n / max(x, 0.01 * n, 1)) for s, x in df.items()}

    def similar(a, b):
        both, either = bags[a] & bags[b], bags[a] | bags[b]
        return sum(idf[s] * x for s, x in both.items()) >= 0.8 * sum(idf[s] * x for s, x in either.items()) - 1e-9

    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and bags[a] and bags[b] and similar(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_near_duplicates_against_brute_force(spark):
    rng, texts = np.random.default_rng(3), {}
    for g in range(12):
        base = words(rng, int(rng.integers(8, 200)))
        for _ in range(int(rng.integers(1, 14))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 5))):
                copy[int(rng.integers(len(copy)))] = "edited"
            texts[len(texts) * 3 + 1] = " ".join(copy)
    texts |= {1000: "a b", 1001: "A, b!", 1002: "", 1003: None, 1004: "...", 1005: None, 1006: "one two one two one two one two one two", 1007: "x" * 100_000}
    want = near_classes({i: t for i, t in texts.items()})
    rows = spark.createDataFrame([(i, t, "e") for i, t in texts.items()], "doc_id long, text string, elements string")
    got = nd.near_duplicate_classes(rows).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    kept = Counter(r.class_id for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == set(want.values())
    assert want[1001] == 1000 and want[1005] == 1005


def test_large_groups_lose_no_link(spark, monkeypatch):
    """Groups larger than a block, whose members resemble a base more than each other."""
    monkeypatch.setattr(nd, "BLOCK", 16)
    rng, texts = np.random.default_rng(5), {}
    base = words(rng, 120)
    for i in range(90):
        copy = list(base)
        for k in rng.choice(len(copy), int(rng.integers(0, 6)), replace=False):
            copy[int(k)] = f"new{rng.integers(9999)}"
        texts[i] = " ".join(copy)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in nd.near_duplicate_classes(rows).collect()} == near_classes(texts)


def test_near_dedup_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicate_classes(none).count() == 0
    rows = spark.createDataFrame([(5, "same words are here now"), (5, "same words are here now"), (None, "same words are here now"), (2, "Same words, are here now.")], "doc_id long, text string")
    got = nd.near_duplicate_classes(rows).collect()
    assert {r.class_id for r in got} == {2} and [r.doc_id for r in got if r.kept] == [2]


def test_weighted_sampling_estimates_similarity():
    rng = np.random.default_rng(1)
    shared, one, two = (np.unique(rng.integers(0, 2**32, n, dtype=np.uint32)) for n in (300, 60, 60))
    known = np.concatenate((shared[::2], one[::3], two[::3]))
    weigh = nd.Weights(known, rng.uniform(0.5, 6, len(known)), 4.0)
    sampler = nd.WeightedSampler(weigh, 512)
    # some shingles occur again, in both documents or in one
    a, b = np.sort(np.concatenate((shared, shared[:40], one))), np.sort(np.concatenate((shared, shared[20:40], two)))
    each = {x: float(weigh(np.array([x], np.uint32))[0]) for x in {*a.tolist(), *b.tolist()}}
    w = lambda bag: sum(each[x] * n for x, n in bag.items())
    x, y = Counter(a.tolist()), Counter(b.tolist())
    assert abs((sampler.signature(a) == sampler.signature(b)).mean() - w(x & y) / w(x | y)) < 0.08


def test_weights_are_exact_document_frequencies(spark, monkeypatch):
    """Whatever shares a counter of the first pass, and however rows are dealt."""
    monkeypatch.setattr(nd, "BUCKETS", 8)
    rng = np.random.default_rng(8)
    docs = [np.sort(rng.integers(0, 4000, int(rng.integers(1, 60)), dtype=np.uint32)) for _ in range(400)] + [np.full(9, 7, np.uint32)] * 30
    rows = spark.createDataFrame([(bytearray(d.tobytes()),) for d in docs], "elements binary")
    df = Counter(x for d in docs for x in set(d.tolist()))
    got = nd.inverse_frequencies(rows.repartition(5), 0.02)
    every = np.arange(4000, dtype=np.uint32)
    want = [1 + math.log(len(docs) / max(df[x], 0.02 * len(docs))) for x in every.tolist()]
    assert np.allclose(got(every), want) and len(got.shingles) - 1 == sum(n >= 0.02 * len(docs) for n in df.values())


def brute_links(rows, least=0.9):
    ok = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for k, _, u in ok:
        for j, _, v in ok:
            if k != j and len(u) == len(v) and u @ v / math.sqrt(u @ u) / math.sqrt(v @ v) >= least:
                links[k].add(j)
    return links


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 8)
    rng, rows = np.random.default_rng(2), []
    for g in range(6):
        centre = rng.standard_normal(16)
        rows += [(len(rows) * 2, (centre + 0.12 * rng.standard_normal(16)).tolist()) for _ in range(14)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, [2 * x for x in rows[3][1]]), (503, None), (504, [0.0] * 16), (505, [float("nan")] + [1.0] * 15), (506, [None] * 16), (507, [float("inf")] * 16), (508, [1.0, 2.0]), (509, []), (None, rows[0][1]), (500, rows[0][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    got = ed.link_embeddings(frame).collect()
    links = brute_links(rows)
    assert Counter((r.vec_id, r.n_links) for r in got) == Counter((rows[k][0], len(v)) for k, v in links.items())
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[k], *(root[j] for j in links[k])]) for k in range(len(rows))]
    for r in got:
        mine = next(k for k, (i, v) in enumerate(rows) if i == r.vec_id)
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[mine] and rows[j][0] is not None]
        assert r.component_id == (min(ids) if ids else r.vec_id)
        assert r.kept == (r.vec_id == r.component_id)


def test_embedding_edges(spark):
    assert ed.link_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    alone = ed.link_embeddings(spark.createDataFrame([(3, None)], "vec_id long, embedding array<float>")).first()
    assert (alone.n_links, alone.component_id, alone.kept) == (0, 3, True)


@pytest.mark.parametrize("n", [10, 10_000, 10**9])
def test_tables_keep_their_recall(n):
    bits, tables = ed.tables_for(n)
    assert (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables <= ed.MISS and n / 2**bits <= 2 * ed.BY_CHANCE + 10
