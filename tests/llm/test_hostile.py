"""Texts made to break an operator: very long, without spaces, full of beginnings that never end; clashing column names."""

import gzip
import math
import re

import pytest
from pyspark.sql import functions as F

from chronoloom.llm import decontaminate as dc
from chronoloom.llm import language_id as li
from chronoloom.llm import line_dedup as ld
from chronoloom.llm import queries, warc
from chronoloom.llm import secret_scan as ss
from chronoloom.llm import url_filter as uf

MB = 1_000_000
#: By kind: texts of about a megabyte that begin like a match again and again.
SECRETS = {
    "assign": ["password" + " " * MB, "token:" * (MB // 6), 'secret="\'' * (MB // 9), "api_key='" + "x" * MB],
    "access": ["AKIA" * (MB // 4), "AKIA" + "a" * MB],
    "hex": ["0123456789abcdef" * (MB // 16) + "g", "0123456789abcdeg" * (MB // 16)],
    "private_key": ["-----BEGIN " + "A " * (MB // 2) + "PRIVATE KEY-----", "-----BEGIN " + "A " * 20_000 + "PRIVATE KEY-----", "-----BEGIN " * (MB // 11), "-----BEGIN " + "A" * MB],
    "hub_token": ["ghp_" * (MB // 4), "ghp_" + "a" * MB],
    "chat_token": ["xoxb-" * (MB // 5), "xoxb-" + "é" * MB],
    "web_token": ["eyJ" * (MB // 3), "-eyJ" * (MB // 4), "eyJaaaaaaaaaaaa." * (MB // 16)],
    "any": ["a\U0001f600" * (MB // 2) + "password=abcdefghijklmnop", "x" * MB, "\n" * MB],
}


def test_secret_rules_survive_any_text(spark):
    texts = [t for part in SECRETS.values() for t in part]
    rules = ss.BASE_RULES + ss.MORE_RULES
    got = {r.doc_id: {tuple(s) for s in r.spans} for r in ss.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()}
    for i, text in enumerate(texts):
        # (?i) reaches only ASCII letters in Java, as the rule asks
        want = {(r.kind, m.start(), m.end()) for r in rules for m in re.finditer(r.pattern.replace("(?i)", "(?ai)"), text) if len(m[r.group]) >= r.least}
        assert got[i] == want, text[:40]


def test_more_rules_than_one_word_of_trigrams(spark):
    rules = tuple(ss.Rule(f"k{i}", f"begin{i:03d}end[0-9]+") for i in range(40)) + (ss.Rule("digits", "[0-9]{9,}"),)
    texts = [f"so begin{i:03d}end{i} it is" for i in range(40)] + ["123456789", "begin", ""]
    got = {r.doc_id: [s.kind for s in r.spans] for r in ss.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules).collect()}
    assert got == {**{i: [f"k{i}"] for i in range(40)}, 40: ["digits"], 41: [], 42: []}


def test_secrets_of_repeated_rows_and_odd_columns(spark):
    rows = [(None, "password=abcdefghijkl", 1, 2, 3), (None, "password=abcdefghijkl", 1, 2, 3), (1, None, 1, 2, 3), (1, "token=abcdefghijklm", 1, 2, 3), (1, "token=abcdefghijklm", 1, 2, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row int, digest int, low int")
    assert sorted((r.doc_id or 0, len(r.spans)) for r in ss.find_secrets(frame).collect()) == [(0, 1), (0, 1), (1, 0), (1, 1), (1, 1)]


def test_urls_of_any_length_and_letters(spark):
    mixed = "a\U0001f600"
    urls = [mixed * 20_000 + "://host/x", "x" * MB + "://" + "H" * MB + "/" + "p" * MB, mixed * 20_000 + "://" + mixed * MB + "?q", "://" * (MB // 3), "http://" + "/" * MB, "a://b" + "?" * MB, "http://x.com/de/" + mixed * MB, ":" * MB]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    for r in uf.judge_urls(pages, queries.RULES).select("page_id", "url", "host", "path", "verdict").collect():
        rest = r.url.split("://", 1)[1] if "://" in r.url else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        assert (r.host, r.path) == (host.translate({c: c + 32 for c in range(65, 91)}), path) and r.verdict in ("allow", "block")


@pytest.mark.parametrize("times", [1, 8])
def test_url_sample_is_bounded_and_follows_no_partitioning(spark, times):
    rows = [(f"http://h{i % 900}.{'bad' if i % 3 == 0 else 'good'}/{i % 900}", f"h{i % 900}.{'bad' if i % 3 == 0 else 'good'}", f"/{i % 900}", i % 3 == 0) for i in range(900 * times)] + [("http://hot.bad/", "hot.bad", "/", True)] * 500
    frame = spark.createDataFrame(rows, "url string, host string, path string, blocked boolean")
    seen, fit = [], uf.BoostedTrees.fit

    def watched(self, features, labels, times=None):
        seen.append((len(labels), float(times.sum())))
        return fit(self, features, labels, times)

    uf.BoostedTrees.fit = watched
    try:
        one, two = uf.train(frame.repartition(3), 200), uf.train(frame.repartition(7, "path"), 200)
    finally:
        uf.BoostedTrees.fit = fit
    assert seen[0] == seen[1] and seen[0][0] == 200
    assert all((a == b).all() for x, y in zip(one.trees.trees, two.trees.trees) for a, b in zip(x, y))


def test_lines_of_long_texts_and_clashing_names(spark):
    long = "\n".join(f"line {i}" for i in range(100_000))
    rows = [(1, long, 5, 6, 7, 8, 9), (2, f"before\n{long}\nafter", 5, 6, 7, 8, 9), (3, "x" * MB, 5, 6, 7, 8, 9), (4, "\n" * MB, 5, 6, 7, 8, 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _id int, _hash int, n_removed int, `a.b` int, covered int")
    out = ld.drop_repeated_lines(frame)
    assert out.columns == frame.columns
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].text for i in range(1, 5)] == [long, "before\nafter", rows[2][1], rows[3][1]]
    assert got[2].n_removed == 100_000 and (got[2]._id, got[2]._hash, got[2]["a.b"], got[2].covered) == (5, 6, 8, 9)


def leaks_of(spark, docs, items, **more):
    frame = spark.createDataFrame(docs, "doc_id long, text string, doc int")
    return {r.doc_id: [tuple(x) for x in r.leaks] for r in dc.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string"), **more).collect()}


def test_a_leak_does_not_depend_on_other_items(spark):
    short = "one two three four five six seven eight nine ten eleven twelve"
    apart = " ".join(short.split()[:6]) + " " + " ".join(f"f{i}" for i in range(5000)) + " " + " ".join(short.split()[6:])
    long = " ".join(f"long{i}" for i in range(6000))
    docs = [(1, apart, 0), (2, f"{apart} {short}", 0), (3, f"so {long} it is", 0), (4, None, 0)]
    alone, beside = leaks_of(spark, docs, [(1, short)]), leaks_of(spark, docs, [(1, short), (2, long)])
    assert {d: [x[0] for x in v] for d, v in alone.items()} == {1: [], 2: [1], 3: [], 4: []}
    assert {d: [x[0] for x in v] for d, v in beside.items()} == {1: [], 2: [1], 3: [2], 4: []}


def test_one_and_four_indexes_agree_to_the_last_digit(spark):
    items = [(i % 17, " ".join(f"w{(i * 7 + j * (i % 5 + 1)) % 90}" for j in range(8 + 9 * (i % 11)))) for i in range(60)] + [(3, "again and again the same"), (3, "again and again the same"), (None, "an item without an id here"), (5, ""), (6, None)]
    docs = [(i, f"so {items[i][1]} and {items[(i * 3) % 60][1]}", 0) for i in range(60)] + [(100, "Again and again the same; an item without an id here", 0), (101, None, 0), (102, "", 0)]
    size = sum(len(t or "") for _, t in items)
    one, four = leaks_of(spark, docs, items), leaks_of(spark, docs, items, index_chars=size // 4 + 1)
    assert one == four and [x[0] for x in one[100]] == [None, 3, 3] and not one[101] and sum(map(len, one.values())) > 120


def brute_language(text, samples):
    """Bits per character by searching the samples themselves for each longest match."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not letters or not samples:
        return "und", 0.0
    padded, rates = f" {' '.join(letters)} ", []
    for name, sample in samples.items():
        at = bits = 0
        while at < len(padded):
            n = 0
            while at + n < len(padded) and padded[at : at + n + 1] in sample:
                n += 1
            bits += math.log2(max(2, len(sample))) + 4.0 + (0 if n else math.log2(0x110000))
            at += max(1, n)
        rates.append((bits / len(padded), name))
    rates.sort()
    return rates[0][1], rates[1][0] / (rates[1][0] + rates[0][0]) if len(rates) > 1 else 1.0


@pytest.mark.parametrize("languages", [None, 1, 2])
def test_languages_and_scores_against_brute_force(spark, languages):
    """Whole texts, over word borders; the same in one block of languages as in several."""
    rows = [(r.doc_id, r.text, r.lang, 1) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null and length(text) < 3000").orderBy("doc_id").limit(60).collect()]
    rows += [(2000 + i, t, None, 1) for i, t in enumerate([None, "", "12 ... ²", "x", "ǆ ß ﬁ", "nó t", "alpha " * 300])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, found int")
    labels = sorted({r[2] for r in rows if r[2]})
    part = {"sample_docs": 5, "doc_chars": 300, "lang_chars": 900}
    known = li.training_rows(frame)
    samples = li.training_texts(known, {x: known.where(known.lang == x).count() for x in labels}, **part)
    assert sorted(samples) == labels and all(len(x) <= 901 for x in samples.values())
    out = li.predict_languages(frame, languages=languages, **part)
    assert out.columns == ["doc_id", "text", "lang", "found", "held_out", "lang_pred", "score", "phrase_rate"]
    for r in out.collect():
        if r.text and "́" in r.text:
            continue  # marks are letters' parts for the operator only
        name, score = brute_language(r.text, samples)
        assert r.lang_pred == name and r.score == pytest.approx(score, abs=1e-12), r.text
        assert r.found == 1


def test_languages_of_long_texts_and_clashing_names(spark):
    rows = [(i, t, g, 1, 2, 3) for i, (t, g) in enumerate([("the cat and the dog " * 50, "en"), ("der hund und die katze " * 50, "de")] * 4)]
    rows += [(100, "the cat and the dog " * 50_000, None, 1, 2, 3), (101, "dieunddiekatzeundderhund" * 40_000, None, 1, 2, 3), (102, " ".join(f"und{i}" for i in range(100_000)), None, 1, 2, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, _lang int, row int, doc int")
    got = {r.doc_id: r for r in li.predict_languages(frame).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["en", "de", "de"] and (got[100]._lang, got[100].row, got[100].doc) == (1, 2, 3)


def test_archives_with_broken_records(spark, tmp_path):
    """Bad lengths, no lengths, records within payloads, a cut end: what is whole is read, in every layout."""
    body = b"HTTP/1.1 200 OK\r\n\r\n"
    one = lambda name, block=body + b"x": warc.record("response", name, "http://a", "application/http; msgtype=response", block)
    inner = one("urn:inner")
    good = [one("urn:1"), one("urn:2", body + inner + b"WARC/1." * 50_000), one("urn:3"), one("urn:4", b""), one("urn:5", body + b"y" * MB)]
    bad = [one("urn:b1").replace(b"Content-Length: 20", b"Content-Length: twenty"), one("urn:b2").replace(b"Content-Length: 20\r\n", b""), one("urn:b3").replace(b"Content-Length: 20", b"Content-Length: -1"), b"noise WARC/1.1 noise\r\n\r\n", one("urn:b4").replace(b"WARC-Record-ID", b"X")]
    whole = b"".join(x for pair in zip(good, bad) for x in pair) + one("urn:cut", body + b"z" * 99)[:-60]
    parts = [x for pair in zip(good, bad) for x in pair]
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    want = ["urn:1", "urn:2", "urn:3", "urn:4", "urn:5"]
    rows = warc.read_records(spark, str(tmp_path)).collect()
    for name in ("a.warc", "b.warc.gz", "c.warc.gz"):
        mine = [r for r in rows if r.file.endswith(name)]
        assert [r.record_id for r in mine] == want
        assert [len(r.payload) for r in mine] == [1, len(inner) + 350_000, 1, 0, MB]
    for data in (whole, gzip.compress(whole)):
        assert [dict(f)["WARC-Record-ID"] for f, _ in warc.parse_archive(data)] == [f"<{x}>" for x in want]


def test_archive_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"{i}" + "é" * 10_000) for i in range(40)], "page_id long, url string, html string").repartition(1)
    got = warc.archive_and_read(pages, payloads=False).collect()
    assert sorted((int(r.page_id), r.response.payload_bytes) for r in got) == [(i, 20_000 + len(str(i))) for i in range(40)]
    path = warc.new_path(spark, "test")
    warc.write_archives(pages, path)
    assert len({r.file for r in warc.read_records(spark, path).select("file").distinct().collect()}) == 10
