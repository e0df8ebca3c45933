"""Benchmark decontamination: every passage of the corpus queries a BM25 index of test items.

Passages are windows of words that overlap by half. Their width depends on the item alone:
items are searched by classes of length (up to 64 words, up to 256, and so on by fours), and a
class has windows of three times its greatest length, so that any region of one and a half
times that length lies in some window. Whether an item leaks thus does not depend on which
other items there are. The threshold of an item is the least BM25 score that a passage can
have which holds enough of the item's five-word shingles, so retrieval loses no leak:

1. Pivot test, for all passages of a batch at once: of each item a set of rare terms is
   essential, because its other terms together stay below its threshold. A passage whose
   essential terms cannot make up the difference for any item is done.
2. Block-max WAND over the inverted index retrieves, for each passage left, all items
   at or above their thresholds.
3. Verification: at least 0.8 of the item's shingles stand in the passage, and at least
   0.8 of the words of its question and of its answer. The answer is the last quarter
   of the words, five at least; items of under ten words are all question and answer.

Words are runs of letters and digits, lower-cased. An item of fewer than five words is
one shingle; items without words are in no passage. Null and empty texts leak nothing; of
very long texts every window is searched. Items with equal ids are separate items, and an
item that occurs several times leaks as often. Output columns replace input columns of the
same name; others pass through, whatever they are called.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType

from ..shared import materialise
from .pieces import bound_batches, resident

SHINGLE, SIMILARITY = 5, 0.8
#: One index holds items of about so many characters; more items are searched in several
#: indexes, one job after the other. Weights and thresholds are the same in either case.
INDEX_CHARS = 4_000_000
#: The least class of item lengths in words, and the step from one class to the next.
LEAST_CLASS, CLASS_STEP = 64, 4
POSTING_BLOCK = 16
K1, B = 1.2, 0.75
words_of = re.compile(r"[^\W_]+").findall


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []


class Item:
    def __init__(self, item_id, words: list[str]):
        self.item_id, self.words = item_id, words
        cut = len(words) - max(SHINGLE, math.ceil(len(words) / 4))
        self.question, self.answer = (set(words[:cut]), set(words[cut:])) if len(words) >= 2 * SHINGLE else (set(words), set(words))
        counted = Counter(shingles(words))
        self.shingles = set(counted)
        #: How many shingles may be missing, and how many words at most are missing then.
        spare = math.floor(len(counted) * (1 - SIMILARITY) + 1e-9)
        self.spare_words = sum(sorted(counted.values(), reverse=True)[:spare])

    def overlaps(self, passage: list[str]) -> tuple[float, float, float]:
        """Shares of the item's shingles, question words and answer words in the passage."""
        there, have = set(passage), set(shingles(passage)) if len(self.words) >= SHINGLE else set()
        if len(self.words) < SHINGLE:
            n = len(self.words)
            have = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
        return len(self.shingles & have) / len(self.shingles), len(self.question & there) / len(self.question), len(self.answer & there) / len(self.answer)


class Statistics(NamedTuple):
    """Of all items, whichever are in one index: how many, their words, and how many hold a word."""

    items: int
    words: int
    holding: dict[str, int]


def statistics_of(items: list[Item]) -> Statistics:
    return Statistics(len(items), sum(len(i.words) for i in items), Counter(w for item in items for w in set(item.words)))


def length_class(words: int) -> int:
    """The greatest length of the class of an item of so many words."""
    size = LEAST_CLASS
    while size < words:
        size *= CLASS_STEP
    return size


class Bm25Index:
    """Postings by term, with the greatest weight of each block of postings.

    Weights are divided by the item's threshold, so every item is retrieved from 1 up.
    """

    def __init__(self, items: list[tuple[object, str | None]], whole: Statistics | None = None, term: dict[str, int] | None = None):
        self.items = [i for i in (Item(k, words_of((t or "").lower())) for k, t in items) if i.words]
        whole = whole or statistics_of(self.items)
        n, df = whole.items, whole.holding
        self.term = term or {w: k for k, w in enumerate(sorted({w for i in self.items for w in i.words}))}
        mean = whole.words / max(1, n)
        postings: dict[int, list[tuple[int, float]]] = {}
        self.slack = np.zeros(len(self.items))
        essential: list[tuple[int, int, float]] = []
        for k, item in enumerate(self.items):
            tf = Counter(item.words)
            long = K1 * (1 - B + B * len(item.words) / mean)
            weight = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + long) for w, c in tf.items()}
            total = sum(weight.values())
            least = max(total - sum(sorted(weight.values(), reverse=True)[: item.spare_words]), 1e-3 * total) * (1 - 1e-9)
            rest = total
            for w in sorted(weight, key=lambda w: (df[w], w)):
                # a term stays essential while the commoner ones could still reach half of the threshold alone
                if rest < least / 2:
                    break
                rest -= weight[w]
                essential.append((self.term[w], k, weight[w] / least))
            self.slack[k] = 1 - rest / least - 1e-6
            for w, x in weight.items():
                postings.setdefault(self.term[w], []).append((k, x / least))
        self.postings = {t: (np.array([k for k, _ in p]), np.array([x for _, x in p])) for t, p in postings.items()}
        self.block_max = {t: [float(x[i : i + POSTING_BLOCK].max()) for i in range(0, len(x), POSTING_BLOCK)] for t, (_, x) in self.postings.items()}
        self.block_last = {t: [int(k[min(i + POSTING_BLOCK, len(k)) - 1]) for i in range(0, len(k), POSTING_BLOCK)] for t, (k, _) in self.postings.items()}
        self.most = {t: max(b) for t, b in self.block_max.items()}
        essential.sort()
        self.e_items, self.e_weights = np.array([e[1] for e in essential], np.int64), np.array([e[2] for e in essential])
        self.e_start = np.searchsorted(np.array([e[0] for e in essential], np.int64), np.arange(len(self.term) + 1))
        #: Half a passage: any region that holds a leak fits into two neighbours.
        self.half = math.ceil(1.5 * length_class(max((len(i.words) for i in self.items), default=1)))

    def pivot_test(self, terms: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Of passages made of blocks p and p + 1, those that can reach some item's threshold."""
        key = np.unique(blocks[terms >= 0] * len(self.term) + terms[terms >= 0])
        block, term = np.divmod(key, max(1, len(self.term)))
        sizes = self.e_start[term + 1] - self.e_start[term]
        at = np.repeat(self.e_start[term] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum()) if len(key) else np.zeros(0, np.int64)
        block, item, weight = np.repeat(block, sizes), self.e_items[at], self.e_weights[at]
        pair, where = np.unique(np.concatenate((block, block - 1)) * max(1, len(self.items)) + np.concatenate((item, item)), return_inverse=True)
        sums = np.bincount(where, np.concatenate((weight, weight)), len(pair))
        passage, item = np.divmod(pair, max(1, len(self.items)))
        return np.unique(passage[sums >= self.slack[item]])

    def retrieve(self, terms: set[int]) -> list[tuple[int, float]]:
        """Block-max WAND: (item number, score) of all items whose score is 1 or more."""
        lists = [[0, t, *self.postings[t], 0] for t in terms]  # position, term, items, weights, block
        found, end = [], len(self.items)
        current = [int(x[2][0]) for x in lists]
        while True:
            order = sorted((c, j) for j, c in enumerate(current) if c < end)
            bound, pivot = 0.0, -1
            for k, (_, j) in enumerate(order):
                bound += self.most[lists[j][1]]
                if bound >= 1 - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = order[pivot][0]
            upto = [j for c, j in order if c <= item]
            block_bound, skip = 0.0, end
            for j in upto:
                last, b = self.block_last[lists[j][1]], lists[j][4]
                while b < len(last) and last[b] < item:
                    b += 1
                lists[j][4] = b
                if b < len(last):
                    block_bound += self.block_max[lists[j][1]][b]
                    skip = min(skip, last[b] + 1)
            if block_bound < 1 - 1e-9:
                # nothing up to the first block border can reach the threshold
                following = [c for c, _ in order if c > item]
                to = max(item + 1, min([skip, *following]))
            else:
                weights = []
                for j in upto:
                    p = lists[j][0] + int(np.searchsorted(lists[j][2][lists[j][0] :], item))
                    if p < len(lists[j][2]) and lists[j][2][p] == item:
                        weights.append(float(lists[j][3][p]))
                score = math.fsum(weights)  # the same in whatever order
                if score >= 1 - 1e-9:
                    found.append((item, score))
                to = item + 1
            for j in upto:
                p = lists[j][0] = lists[j][0] + int(np.searchsorted(lists[j][2][lists[j][0] :], to))
                current[j] = int(lists[j][2][p]) if p < len(lists[j][2]) else end

    def leaks(self, words: list[list[str]], terms: np.ndarray) -> list[dict[int, tuple[float, float, float, float]]]:
        """For each list of words, by item number: score, and shares of shingles, question and answer.

        ``terms`` holds the term numbers of all lists, one after the other, -1 for unknown words.
        """
        out: list[dict[int, tuple[float, float, float, float]]] = [{} for _ in words]
        get, half = self.term.get, self.half
        sizes = [len(w) for w in words]
        spans = [-(-n // half) + 1 for n in sizes]  # one empty block keeps documents apart
        first = np.concatenate(([0], np.cumsum(spans)))
        within = np.arange(len(terms)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        blocks = np.repeat(first[:-1], sizes) + within // half
        for passage in self.pivot_test(terms, blocks).tolist():
            d = int(np.searchsorted(first, passage, side="right")) - 1 if passage >= 0 else -1
            if d < 0:
                continue
            k = passage - int(first[d])
            part = words[d][k * half : (k + 2) * half]
            for item, score in self.retrieve({get(w) for w in part} & self.postings.keys()):
                shares = self.items[item].overlaps(part)
                if min(shares) >= SIMILARITY - 1e-9 and (score, *shares) > out[d].get(item, ()):
                    out[d][item] = (score, *shares)
        return out


class Benchmark:
    """Items given as (id, text, times), with one index for each class of lengths."""

    def __init__(self, rows: list[tuple[object, str, int]], whole: Statistics | None = None):
        items = [(k, t, n, words) for k, t, n in rows if (words := words_of((t or "").lower()))]
        whole = whole or statistics_of([Item(k, words) for k, _, n, words in items for _ in range(n)])
        self.term = {w: k for k, w in enumerate(sorted({w for *_, words in items for w in words}))}
        classes: dict[int, list] = {}
        for item in items:
            classes.setdefault(length_class(len(item[3])), []).append(item)
        self.indexes = [(Bm25Index([(k, t) for k, t, _, _ in part], whole, self.term), [n for _, _, n, _ in part]) for _, part in sorted(classes.items())]

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text the items that leak into it, as often as they occur."""
        words = [words_of((t or "").lower()) for t in texts]
        terms = np.fromiter((t for w in words for t in map(self.term.get, w, repeat(-1))), np.int64, sum(map(len, words)))
        out: list[list[dict]] = [[] for _ in texts]
        for index, times in self.indexes:
            for found, leaks in zip(out, index.leaks(words, terms)):
                for number, (score, overlap, question, answer) in leaks.items():
                    leak = {"item_id": index.items[number].item_id, "score": score, "overlap": overlap, "question": question, "answer": answer}
                    found.extend([leak] * times[number])
        return out


def _search(shipped, kind):
    """A function on texts over the index of the broadcast items, built once per worker."""
    token = uuid.uuid4().hex
    leak_type = pa.list_(pa.struct([("item_id", to_arrow_type(kind)), *((n, pa.float64()) for n in ("score", "overlap", "question", "answer"))]))

    @arrow_udf(f"array<struct<item_id:{kind.simpleString()},score:double,overlap:double,question:double,answer:double>>")
    def search(texts: pa.Array) -> pa.Array:
        index, out = resident(("bm25", token), lambda: Benchmark(*shipped.value)), []
        for k in range(0, len(texts), 200):
            out += index.leaks(texts[k : k + 200].to_pylist())
        return pa.array(out, leak_type)

    return search


@arrow_udf(ArrayType(StringType()))
def _words(texts: pa.Array) -> pa.Array:
    return pa.array([words_of((t or "").lower()) for t in texts.to_pylist()], pa.list_(pa.string()))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", index_chars: int | None = None) -> DataFrame:
    """``docs`` with ``leaks``: an array of (item_id, score, overlap, question, answer) by item id.

    The items' size is read first. Items of at most ``index_chars`` characters (INDEX_CHARS if absent) are broadcast
    as one index within the plan. More items are a query set searched in blocks: a job for each
    block broadcasts its items and writes what leaks, so that neither the driver nor a worker
    ever holds more than one block; statistics over all items come from a table.
    """
    spark, index_chars = docs.sparkSession, index_chars or INDEX_CHARS
    bound_batches(spark)
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("length(text) > 0").groupBy("item_id", "text").agg(F.count("*").alias("times"))
    items = materialise(items, "items")
    parts = -(-(items.agg(F.sum(F.length("text")).alias("n")).first().n or 0) // index_chars) or 1
    kind, part = items.schema["item_id"].dataType, F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    if parts == 1:
        rows = items.collect()  # index_chars characters at most
        shipped = spark.sparkContext.broadcast(([(r.item_id, r.text, r.times) for r in rows], None))
        return docs.withColumn("leaks", F.array_sort(_search(shipped, kind)(F.col(text))))
    worded = materialise(items.select("times", part.alias("part"), _words("text").alias("words")).where(F.size("words") > 0), "item_words")
    total = worded.agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.size("words")).alias("words")).first()
    each = worded.select("part", "times", F.explode(F.array_distinct("words")).alias("word"))
    holding = materialise(each.groupBy("word").agg(F.sum("times").alias("n")), "holding")
    numbered = materialise(docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("doc"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")), "numbered")
    found = []
    for number in range(parts):
        rows = items.where(part == number).collect()  # about index_chars characters, and their words
        known = {r.word: r.n for r in holding.join(each.where(F.col("part") == number).select("word").distinct(), "word").collect()}
        shipped = spark.sparkContext.broadcast(([(r.item_id, r.text, r.times) for r in rows], Statistics(total.n, total.words, known)))
        found.append(materialise(numbered.select("row", _search(shipped, kind)("text").alias("leaks")).where(F.size("leaks") > 0), "leaks"))
        shipped.destroy()
    leaks = found[0]
    for more in found[1:]:
        leaks = leaks.unionByName(more)
    leaks = leaks.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    columns = [F.col(f"doc.c{i}").alias(c) for i, c in enumerate(docs.columns) if c != "leaks"]
    none = F.array().cast(leaks.schema["leaks"].dataType)
    return numbered.join(leaks, "row", "left").select(*columns, F.coalesce("leaks", none).alias("leaks"))
