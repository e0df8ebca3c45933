"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles.

A document is the multiset of its five-word shingles. A shingle that occurs t times weighs
t times its inverse document frequency, 1 + ln(N / max(df, RARE * N)), with N documents of
which df hold it. The frequencies are those of single shingles, counted exactly over all
documents; all that stand in less than RARE of them share the greatest weight. So the table
of weights has at most (mean number of different shingles of a document) / RARE rows, however
many documents there are. Improved consistent weighted sampling gives a signature whose
entries agree with the probability of the weighted Jaccard similarity. Bands of the
signature are bucket keys.

Verification computes the weighted Jaccard similarity of the multisets (of 32-bit shingle
hashes: within a pair of documents of a thousand words two shingles share one with a chance
below 0.001, which moves the similarity by less than 0.001). In every bucket all members are
compared with its smallest member; members that this leaves in another component are
compared with all others of the bucket that are in a different component, in blocks of
bounded size. No bucket is cut short and none is taken apart in a single task. Links join two
documents whose weighted Jaccard similarity is 0.8 or more; linked documents form a class.

Documents with equal word sequences (case and punctuation apart) are copies: one of them
is compared, all are in its class. Documents of fewer than five words are one shingle.
Null texts and texts without words link with nothing. Texts of any length are taken whole:
a document is held by one row at a time, with four bytes for each word. Rows are never
merged; a null doc_id counts as larger than any other when a class is named. Columns of the
input that are neither named nor carried are not read, whatever they are called.
"""

from __future__ import annotations

import math
import re
import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..operators.components import connected_components, join_hot
from ..shared import forget, materialise
from .pieces import Bounded, bound_batches, resident

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at the least similarity shares a band with probability 1 - (1 - 0.8^4)^16 > 0.9997.
BANDS, ROWS = 16, 4
#: Shingles in less than this share of the documents count as equally rare.
RARE = 0.01
#: Counters of the first pass, which finds where frequent shingles can be.
BUCKETS = 1 << 18
#: Members of a bucket that one task compares at once.
BLOCK = 400
words_of = re.compile(r"[^\W_]+").findall
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Shingler:
    """Texts to elements: the sorted 32-bit hashes of their shingles, as often as they occur."""

    def __init__(self):
        self.memo = Bounded(_word_hash, 200_000)

    def __call__(self, text: str | None) -> tuple[bytes | None, bytes]:
        """A key that copies share (None without words), and the elements."""
        words = words_of((text or "").lower())
        if not words:
            return None, b""
        hashes = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        key = blake2b(hashes.tobytes(), digest_size=16).digest()
        n = max(1, len(words) - SHINGLE + 1)
        total = np.zeros(n, np.uint64)
        for k in range(min(SHINGLE, len(words))):
            total = mix(total + _U(k + 1)) ^ hashes[k : k + n]
        return key, np.sort(mix(total).astype(np.uint32)).tobytes()


def occurrences(elements: np.ndarray) -> np.ndarray:
    """One 64-bit number for each element of a sorted array: the shingle, and which occurrence of it this is."""
    out = elements.astype(np.uint64)
    repeat = np.flatnonzero(elements[1:] == elements[:-1]) + 1
    if len(repeat):
        every = np.arange(len(elements))
        first = np.ones(len(elements), bool)
        first[repeat] = False
        out |= (every - np.maximum.accumulate(np.where(first, every, 0))).astype(np.uint64) << _U(32)
    return out


class Weights:
    """The weight of every shingle: of the frequent ones from a table, of all others ``rare``."""

    def __init__(self, shingles: np.ndarray, weights: np.ndarray, rare: float):
        order = np.argsort(shingles)
        # a last entry that is met by search but never equal
        self.shingles = np.append(shingles[order].astype(np.int64), 1 << 40)
        self.weights, self.rare = np.append(weights[order], rare), rare

    def __call__(self, elements: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.shingles, elements.astype(np.int64))
        return np.where(self.shingles[at] == elements, self.weights[at], self.rare)


class WeightedSampler:
    """Improved consistent weighted sampling (Ioffe 2010), many signature entries at a time."""

    def __init__(self, weights: Weights, size: int = BANDS * ROWS):
        self.weights = weights
        self.seeds = mix(np.arange(1, size + 1, dtype=np.uint64) * _U(0xA24BAED4963EE407))

    def signature(self, elements: np.ndarray) -> np.ndarray:
        """One 64-bit sample (element and level) per entry."""
        out = np.zeros(len(self.seeds), np.uint64)
        best = np.full(len(self.seeds), np.inf, np.float32)
        numbers, log_weights = mix(occurrences(elements)), np.log(self.weights(elements)).astype(np.float32)
        for k in range(0, len(elements), 1024):
            part = numbers[k : k + 1024]
            one = mix(part[:, None] + self.seeds)
            two = mix(one + _U(0x9FB21C651E98DF25))
            low, shift, scale = _U(0xFFFFFF), _U(24), np.float32(2**-24)
            unit = lambda x: ((x & low).astype(np.float32) + np.float32(0.5)) * scale
            # r and c follow Gamma(2, 1), beta is uniform
            r = -np.log(unit(one) * unit(one >> shift))
            c = -np.log(unit(two) * unit(two >> shift))
            beta = ((one >> _U(48)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-16)
            level = np.floor(log_weights[k : k + 1024, None] / r + beta)
            a = np.log(c) - r * (level - beta) - r
            at = a.argmin(axis=0)
            every = np.arange(len(at))
            lower = a[at, every] < best
            sample = (part[at] & _U(0xFFFFFFFF00000000)) | (level[at, every].astype(np.int64).astype(np.uint64) & _U(0xFFFFFFFF))
            out[lower], best[lower] = sample[lower], a[at, every][lower]
        return out

    def bands(self, elements: np.ndarray) -> np.ndarray:
        rows = self.signature(elements).reshape(BANDS, ROWS)
        total = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            total = mix(total + rows[:, k])
        return total.astype(np.int64)


def weighted_similarities(query: int, elements: np.ndarray, owner: np.ndarray, weights: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of one document of a block with every document of it.

    ``elements`` are numbered from 0 within the block, ``weights`` are the elements' own.
    """
    mine = np.zeros(int(elements.max()) + 1, bool)
    mine[elements[owner == query]] = True
    shared = np.bincount(owner, weights * mine[elements], len(totals))
    return shared / np.maximum(totals + totals[query] - shared, 1e-12)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``copy_key`` (binary, null without words) and ``elements`` (binary)."""
    bound_batches(docs.sparkSession)

    @arrow_udf("struct<copy_key:binary,elements:binary>")
    def compute(texts: pa.Array) -> pa.Array:
        shingler = resident("shingler", Shingler)
        rows = [shingler(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["copy_key", "elements"])

    out = docs.select(F.struct("*").alias("row"), compute(F.col(text)).alias("f"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("copy_key", "elements")], "f.copy_key", "f.elements")


def inverse_frequencies(rows: DataFrame, rare: float = RARE) -> Weights:
    """1 + ln(documents / documents with the shingle), exact for all shingles in ``rare`` of the documents or more.

    Counters that several shingles share bound the frequencies from above; a second pass counts
    each shingle of those counters that reach the least frequency. Both passes combine within
    a batch and before the shuffle.
    """
    spark = rows.sparkSession
    bucket_of = lambda x: x & np.uint32(BUCKETS - 1)

    def count(batches):
        found, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                found[np.unique(bucket_of(np.frombuffer(value.as_py(), np.uint32)))] += 1
                n += 1
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1), pa.int32()), pa.array(np.append(found[held], n), pa.int64())], ["bucket", "n"])

    table = rows.select("elements").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS + 1 rows at most
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    total = int(n[bucket < 0].sum())
    least = max(1, math.ceil(rare * total))
    full = np.zeros(BUCKETS, bool)
    full[bucket[(bucket >= 0) & (n >= least)]] = True
    shipped = spark.sparkContext.broadcast(full)  # BUCKETS flags

    def single(batches):
        for batch in batches:
            parts = [np.frombuffer(v.as_py(), np.uint32) for v in batch.column(0)]
            parts = [np.unique(p[shipped.value[bucket_of(p)]]) for p in parts]
            shingle, times = np.unique(np.concatenate([np.zeros(0, np.uint32), *parts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingle.astype(np.int64)), pa.array(times.astype(np.int64))], ["shingle", "n"])

    frequent = rows.select("elements").mapInArrow(single, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    weights = 1 + np.log(max(1, total) / frequent["n"].to_numpy())
    return Weights(frequent["shingle"].to_numpy(), weights, 1 + math.log(max(1, total) / max(rare * total, 1)))


def _compare(grouped, weights):
    """A function on the rows (rid, asks, component, elements) of a block: links (src, dst).

    Only documents in different components are compared, and a block's links form a
    forest: what is joined already needs no further link.
    """

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rid, asks, part = (table[c].to_numpy(zero_copy_only=False) for c in ("rid", "asks", "component"))
        rows = [np.frombuffer(e.as_py(), np.uint32) for e in table["elements"]]
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = np.concatenate(rows)
        own = weights.value(flat)
        _, number = np.unique(np.concatenate([occurrences(r) for r in rows]), return_inverse=True)
        totals = np.bincount(owner, own, len(rows))
        group = {}

        def root(x):
            while group.get(x, x) != x:
                group[x] = group.get(group[x], group[x])
                x = group[x]
            return x

        src, dst = [], []
        for q in np.flatnonzero(asks):
            if not (part != part[q]).any():
                continue
            near = weighted_similarities(q, number, owner, own, totals) >= SIMILARITY - 1e-9
            for x in np.flatnonzero(near & (part != part[q])):
                a, b = root(part[q]), root(part[x])
                if a != b:
                    group[max(a, b)] = min(a, b)
                    src.append(rid[q])
                    dst.append(rid[x])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return grouped.applyInArrow(compare, "src long, dst long")


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, class_id (the smallest doc_id of its class), kept, and ``carry``.

    ``kept`` is true for one row of each class, one with the smallest doc_id. Carried columns
    may have any names but those three.
    """
    spark = docs.sparkSession
    # carried columns travel inside one, so that their names meet none of these
    held = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("carried")
    base = features(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), held), "text").drop("text")
    rows = materialise(base.withColumn("rid", F.monotonically_increasing_id()), "shingles")
    table, token = inverse_frequencies(rows.where("copy_key is not null")), uuid.uuid4().hex
    weights = spark.sparkContext.broadcast(table)  # mean shingles of a document / RARE rows at most

    def sample(batches):
        sampler = resident(("sampler", token), lambda: WeightedSampler(weights.value))
        for batch in batches:
            rows = [np.frombuffer(e.as_py(), np.uint32) for e in batch["elements"]]
            bands = [sampler.bands(r) if len(r) else np.zeros(0, np.int64) for r in rows]
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *bands])))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in whole), lists], [*whole, "bands"])

    whole = ["doc_id", "rid", "copy_key", "carried"]
    kinds = dict(rows.dtypes)
    signed = materialise(rows.mapInArrow(sample, ", ".join(f"`{c}` {kinds[c]}" for c in whole) + ", bands array<long>"), "bands")
    # of copies, the row with the smallest document id is compared; one small row per text
    first = F.min(F.struct(F.isnull("doc_id").alias("n"), "doc_id", "rid"))
    texts = materialise(signed.where("copy_key is not null").groupBy("copy_key").agg(first.alias("f"), F.min("bands").alias("bands")).select("copy_key", F.col("f.rid").alias("rid"), F.col("f.doc_id").alias("doc_id"), "bands"), "texts")
    # a band that two texts share; hot keys are combined before the shuffle
    keys = texts.select("rid", F.explode("bands").alias("band"))
    buckets = materialise(keys.groupBy("band").agg(F.min("rid").alias("leader"), F.max("rid").alias("last")).where("leader < last").select("band", "leader"), "buckets")
    members = materialise(keys.join(buckets, "band"), "members")
    wanted = members.select("rid").distinct()
    held = materialise(rows.select("rid", "elements").join(wanted.hint("shuffle_hash"), "rid", "left_semi"), "held")
    forget(rows)

    stars = members.where("rid <> leader").select("leader", "rid").distinct()
    sizes = materialise(stars.groupBy("leader").agg(F.count("*").alias("n")), "sizes")
    stars = stars.join(sizes, "leader").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    asked = sizes.select("leader", F.col("leader").alias("rid"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1)).alias("part"), F.lit(True).alias("asks"))
    answers = stars.select("leader", "rid", F.pmod(F.xxhash64("rid"), "parts").cast("int").alias("part"), F.lit(False).alias("asks"))
    joined = asked.unionByName(answers).join(held, "rid").withColumn("component", F.col("rid"))
    links = materialise(_compare(joined.groupBy("leader", "part"), weights), "links")
    labels = connected_components(links)

    placed = materialise(members.drop("leader").join(labels.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid")), "placed")
    forget(buckets, members, sizes)
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.min("rid").alias("leader")).where("low < high")
    mixed = materialise(mixed.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).join(placed.select(F.col("band"), F.col("rid").alias("leader"), F.col("component").alias("main")), ["band", "leader"]), "mixed")
    spread = placed.join(mixed.select("band", "parts", "main"), "band").withColumn("own", F.pmod(F.xxhash64("rid", F.lit(3)), "parts").cast("int"))
    # stray members ask: each meets every block of its bucket once; a block goes only where a stray is
    astray = materialise(spread.where("component <> main"), "strays")
    strays = astray.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("band", F.col("own").alias("one"), "other", "rid", "component", F.lit(True).alias("asks"))
    others = spread.join(astray.select("band", F.col("own").alias("one")).distinct(), "band").select("band", "one", F.col("own").alias("other"), "rid", "component", F.lit(False).alias("asks"))
    blocks = strays.unionByName(others).groupBy("band", "one", "other", "rid").agg(F.max("asks").alias("asks"), F.max("component").alias("component")).join(held, "rid")
    more = materialise(_compare(blocks.groupBy("band", "one", "other"), weights), "links")
    found = labels
    labels = connected_components(links.unionByName(more))
    forget(found, links, more, placed, mixed, astray, held)

    # the component's name is the smallest document id, whatever its row numbers are
    named = texts.select("copy_key", "rid", "doc_id").join(labels.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    named = materialise(named, "named")
    first = F.min(F.struct(F.isnull("doc_id").alias("n"), "doc_id", "rid")).alias("f")
    classes = join_hot(named, named.groupBy("component").agg(first, F.count("*").alias("times")), "component", "times")
    classes = classes.select("copy_key", F.col("f.doc_id").alias("class_id"), F.col("f.rid").alias("kept_rid"))
    copies = signed.where("copy_key is not null").groupBy("copy_key").agg(F.count("*").alias("times"))
    out = join_hot(signed, classes.join(copies, "copy_key"), "copy_key", "times")
    forget(labels, texts, named)
    alone = F.col("kept_rid").isNull()
    carried = [F.col(f"carried.c{i}").alias(c) for i, c in enumerate(carry)]
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (alone | (F.col("rid") == F.col("kept_rid"))).alias("kept"), *carried)
