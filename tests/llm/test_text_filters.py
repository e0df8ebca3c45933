"""Language id, decontamination, URLs, secrets and WARC: held-out accuracy, round trips, brute force."""

import gzip
import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from chronoloom.llm import decontaminate as dc
from chronoloom.llm import language_id as li
from chronoloom.llm import queries, warc
from chronoloom.llm import secret_scan as ss
from chronoloom.llm import trigrams as tg
from chronoloom.llm import url_filter as uf

SF = "/root/testdata/sf0.01"


@settings(max_examples=80, deadline=None)
@given(some.text(alphabet="abc ", max_size=40), some.text(alphabet="abcd ", max_size=20))
def test_automaton_parses_greedily(text, probe):
    count = at = 0
    while at < len(probe):
        n = 0
        while at + n < len(probe) and probe[at : at + n + 1] in text:
            n += 1
        at, count = at + max(1, n), count + 1
    assert li.SuffixAutomaton(text).phrases(probe) == count


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_language_id(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([(None, "en"), ("", "en"), ("123 ... ²", "de"), ("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de"), ("the cat and the dog " * 5, None)] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score_of string").withColumnRenamed("score_of", "lang").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in li.predict_languages(docs).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und", "und", "und", "en", "de", "en"] and got[0].score == 0
    assert li.predict_languages(docs.where("false")).count() == 0
    assert {r.lang_pred for r in li.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_decontamination_equals_brute_force(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen"), (2, "alpha beta gamma"), (3, ""), (4, None), (5, "the of and to in a is it the of and to"), (6, "one two three four five six seven eight nine ten eleven twelve thirteen")]
    filler = " ".join(f"word{i}" for i in range(300))
    docs = [(10, f"{filler} {items[0][1].upper()}! {filler}"), (11, items[0][1].replace("twelve", "x")), (12, items[0][1].replace("seven", "x")), (13, "Alpha, beta; GAMMA"), (14, "alpha beta x gamma"), (15, None), (16, ""), (17, filler * 30), (18, "the of and to in a is it the of and to " * 3), (10, "again alpha beta gamma")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, leaks int")
    found = dc.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r.doc_id, x.item_id) for r in found.collect() for x in r.leaks)
    want = []
    for d, t in docs:
        have = dc.words_of((t or "").lower())
        for i, x in items:
            item = dc.Item(i, dc.words_of((x or "").lower()))
            if item.words and min(item.overlaps(have)) >= 0.8:
                want.append((d, i))
    assert got == sorted(want) and (10, 1) in got and (13, 2) in got and (14, 2) not in got and (12, 1) not in got
    assert all(not r.leaks for r in dc.find_leaks(frame, spark.createDataFrame([], "item_id long, text string")).collect())
    assert dc.find_leaks(frame.where("false"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(some.lists(some.lists(some.sampled_from("abcdefghijkl"), min_size=1, max_size=14), min_size=1, max_size=40), some.sets(some.sampled_from("abcdefghijkl"), min_size=1))
def test_block_max_wand_retrieves_all(items, passage):
    index = dc.Bm25Index([(i, " ".join(w)) for i, w in enumerate(items)])
    terms = {index.term[w] for w in passage if w in index.term}
    scores = {}
    for t in terms:
        for k, x in zip(*index.postings[t]):
            scores[int(k)] = scores.get(int(k), 0) + float(x)
    assert {k for k, _ in index.retrieve(terms)} == {k for k, s in scores.items() if s >= 1 - 1e-9}


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "INDEX_CHARS", 40)
    items = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i}") for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"so alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i} so") for i in range(6)], "doc_id long, text string")
    assert [(r.doc_id, r.leaks[0].item_id) for r in dc.find_leaks(docs, items).orderBy("doc_id").collect()] == [(i, i) for i in range(6)]


URLS = [None, "", "nothing", "http://a.org", "HTTP://A.ORG/x", "https://sub.example.org/es/1?q=/fr/", "http://example.org/en/17#x", "http://example.org/en/2", "http://x.com/fr/1", "http://x.com/de/1", "http://notcom/de/1", "http://com/de/", "http://b.net?x://y.org/", "http://b.net/%20//z", "ftp://É.org/é"]


def test_url_rules_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 4)], "page_id long, url string, verdict string")
    for r in uf.judge_urls(pages, queries.RULES).collect():
        host = path = ""
        if r.url and "://" in r.url:
            rest = r.url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [x for x in queries.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        rule = max(fits, key=lambda x: len(x.name), default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
    assert uf.judge_urls(pages.where("false"), queries.RULES).count() == 0
    assert {r.verdict for r in uf.judge_urls(pages, []).collect()} == {"allow"}


def test_trees_learn_from_urls(spark):
    rows = spark.createDataFrame([(f"http://h{i}.{'bad' if i % 3 == 0 else 'good'}/{'x' * (i % 7)}", f"h{i}.{'bad' if i % 3 == 0 else 'good'}", f"/{'x' * (i % 7)}", i % 3 == 0) for i in range(600)], "url string, host string, path string, blocked boolean")
    model = uf.train(rows.where("length(url) % 4 <> 0"))
    held = rows.where("length(url) % 4 = 0").collect()
    chance = model.trees.predict(model.features([r.url for r in held], [r.host for r in held], [r.path for r in held]))
    assert sum((c > 0.5) == r.blocked for c, r in zip(chance, held)) >= 0.98 * len(held)


SECRETS = ["", None, "password = 'abcdefghijkl'", "PASSWD:short", "token=abc secret: abcdefghijklmnop", "secret=token: abcdefghijklmnop", "é AKIA" + "A1" * 8, "AKIAKIA" + "B" * 5 + "x" + "AKIA" + "C" * 14, "0123456789abcdef" * 3 + "g" + "0" * 15, "api_key=\"" + "x" * 12 + "\" apikey=" + "y" * 30, "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "🙂 token:abcdefghijklm"]


def brute_spans(text):
    out, order = [], {r.kind: i for i, r in enumerate(ss.BASE_RULES)}
    for kind, pattern, group, least in (("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)):
        out += [(m.start(), order[kind], m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_secrets_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(SECRETS)] + [(2, SECRETS[2], 1), (None, SECRETS[2], 1)], "doc_id long, text string, spans int")
    base = [r.kind for r in ss.BASE_RULES]
    rows = ss.find_secrets(docs).select("doc_id", ss.joined_spans(F.filter("spans", lambda s: s["kind"].isin(base))).alias("base"), ss.joined_spans(F.col("spans")).alias("spans")).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(SECRETS) + 2 and got[None].base == got[2].base == "assign:0:24"
    for i, text in enumerate(SECRETS):
        assert got[i].base == brute_spans(text), text
    assert got[10].spans.split(",")[-1].startswith("hub_token") or "hub_token:0:40" in got[10].spans
    assert ss.find_secrets(docs.where("false")).count() == 0


@pytest.mark.parametrize("rule", ss.BASE_RULES + ss.MORE_RULES, ids=lambda r: r.kind)
def test_trigram_queries_lose_nothing(rule):
    def holds(query, text):
        if query is None or isinstance(query, str):
            return query is None or query in text
        return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])

    query = tg.trigram_query(rule.pattern)
    for text in SECRETS:
        if text and re.search(rule.pattern, text):
            assert holds(query, text.lower())


def test_trigram_query_shapes():
    assert tg.trigram_query("[a-z]+") is None
    assert tg.trigram_query("abcd") == ("and", ("abc", "bcd"))
    assert tg.trigram_query("(abc|xyz)+") == ("or", ("abc", "xyz"))
    assert tg.trigram_query("ab?c") is None


def test_warc_round_trip(spark):
    pages = [(3, "http://a/1?q", "same"), (1, "http://b\r\n/x y", "same"), (2, None, None), (4, "http://c", ""), (5, "http://d", "WARC/1.1\r\n\r\n fake é" * 50), (None, "http://e", "same"), (1, "http://b", "same")]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, record_type int")
    got = warc.archive_and_read(frame).collect()
    assert len(got) == len(pages) and all(r.request and r.metadata for r in got)
    kinds = sorted((r.page_id or "", r.response.type, r.response.payload_bytes, r.response.payload_digest) for r in got)
    digest = lambda t: warc.base32_sha1((t or "").encode())
    assert kinds == sorted([("3", "revisit", 4, digest("same")), ("1", "response", 4, digest("same")), ("1", "response", 4, digest("same")), ("2", "response", 0, digest("")), ("4", "revisit", 0, digest("")), ("5", "response", len(pages[4][2].encode()), digest(pages[4][2])), ("", "revisit", 4, digest("same"))])
    assert {bytes(r.response.payload).decode() for r in got if r.response.type == "response"} == {"same", "", pages[4][2]}
    assert {r.response.refers_to for r in got if r.page_id == "3"} == {"urn:page:1"}
    assert {r.response.type for r in warc.archive_and_read(frame.where("html = 'same'"), least_bytes=5).collect()} == {"response"}
    assert warc.archive_and_read(frame.where("false")).count() == 0


def test_warc_parsing_of_other_layouts():
    one = warc.record("response", "urn:x", "http://a", "application/http; msgtype=response", b"HTTP/1.1 404 No\r\nA: b\r\n\r\nbody")
    two = warc.record("metadata", "urn:y", None, "application/warc-fields", b"k: v\r\n", WARC_Concurrent_To="<urn:x>")
    for data in (one + two, gzip.compress(one + two), gzip.compress(one) + gzip.compress(two)):
        assert [dict(f)["WARC-Type"] for f, _ in warc.parse_archive(data)] == ["response", "metadata"]


def test_concurrent_to_in_either_direction(spark, tmp_path):
    records = warc.record("request", "urn:q", "http://a", "application/http; msgtype=request", b"GET / HTTP/1.1\r\n\r\n")
    records += warc.record("response", "urn:r", "http://a", "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\n\r\nbody", WARC_Concurrent_To="<urn:q>")
    records += warc.record("metadata", "urn:m", None, "application/warc-fields", b"page_id: 9\r\n", WARC_Concurrent_To="<urn:r>")
    records += warc.record("response", "urn:alone", None, "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\n\r\n")
    (tmp_path / "a.warc").write_bytes(records)
    got = {r.record_id: r for r in warc.assemble(warc.read_records(spark, str(tmp_path))).collect()}
    assert got["urn:r"].request.record_id == "urn:q" and got["urn:r"].page_id == "9" and got["urn:r"].response.status == 200
    assert got["urn:alone"].request is None and got["urn:alone"].page_id is None


def test_digest():
    assert warc.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39a3ee")
