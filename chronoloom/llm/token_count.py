"""Token counts by rank-synchronous merging of ragged arrays.

The pieces of a batch lie one after another in a single numpy array of symbols. In
every round each piece looks up the ranks of its adjacent pairs, picks its lowest,
and joins all occurrences of that pair, all pieces at once. Pieces with no pair left
drop out; what a piece still holds then is its count.

Null text counts zero tokens. Output columns replace input columns of the same name.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .pieces import BYTE_LEVEL, bound_batches, resident, splitter

PIECES_KEPT = 400_000
#: A longer piece is counted anew each time it occurs.
LONGEST_KEPT = 256
#: Symbols held in one ragged array at most, unless a single piece is longer.
SYMBOLS_AT_ONCE = 1 << 18
NONE = np.int64(1 << 60)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file.

    Printable Latin-1 bytes stand for themselves; the others follow from code point 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class RaggedMerger:
    """The merges of a byte-level BPE file as sorted arrays."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        self.width = max(vocab.values(), default=0) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.letters = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.letters[byte] = vocab[letter]

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """How many tokens each of the pieces has."""
        out = np.array([len(p) for p in pieces], np.int64)
        symbols = self.letters[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), out)
        while len(symbols) > 1:
            key = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.where(known, self.ranks[at], NONE)
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.minimum.reduceat(np.append(rank, NONE), starts)
            sizes = np.diff(np.append(starts, len(owner)))
            joins = (rank == np.repeat(lowest, sizes)[:-1]) & known
            # "aaa" holds two overlapping pairs: in a row of adjacent joins every other one counts
            place = np.flatnonzero(joins)
            if len(place):
                fresh = np.concatenate(([True], np.diff(place) > 1))
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
                place = place[(np.arange(len(place)) - first) % 2 == 0]
            symbols[place] = self.made[at[place]]
            left = np.repeat(lowest < NONE, sizes)
            left[place + 1] = False
            out -= np.bincount(owner[place], minlength=len(out))
            symbols, owner = symbols[left], owner[left]
        return out


class Counter:
    """Counts the tokens of texts, with the file's special tokens honoured inside them."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only plain byte-level BPE files are understood")
        self.merger, self.split = RaggedMerger(spec["model"]), splitter(BYTE_LEVEL)
        special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.memo: dict[str, int] = {}

    def _learn(self, pieces: list[str]) -> list[int]:
        data, out, k = [p.encode() for p in pieces], [], 0
        while k < len(data):
            end, held = k + 1, len(data[k])
            while end < len(data) and held + len(data[end]) <= SYMBOLS_AT_ONCE:
                held += len(data[end])
                end += 1
            out += self.merger.counts(data[k:end]).tolist()
            k = end
        return out

    def __call__(self, texts: list[str | None]) -> list[int]:
        if len(self.memo) > PIECES_KEPT:
            self.memo.clear()
        memo, out = self.memo, []
        block: list[tuple[int, list[str]]] = []
        waiting: dict[str, None] = {}
        held = 0

        def flush() -> None:
            nonlocal held
            names = list(waiting)
            found = dict(zip(names, self._learn(names)))
            memo.update((p, n) for p, n in found.items() if len(p) <= LONGEST_KEPT)
            for special, pieces in block:
                out.append(special + sum(memo[p] if p in memo else found[p] for p in pieces) if found else special + sum(map(memo.__getitem__, pieces)))
            block.clear()
            waiting.clear()
            held = 0

        for text in texts:
            parts, special = [text or ""], 0
            if self.special and self.special.search(text or ""):
                parts = self.special.split(text)
                special = len(parts) - 1
            pieces = [p for part in parts for p in self.split(part)] if special else self.split(parts[0])
            block.append((special, pieces))
            waiting.update((p, None) for p in set(pieces).difference(memo))
            held += len(pieces)
            if held > 200_000:
                flush()
        flush()
        return out


def _counter(blob: bytes) -> Counter:
    return resident(("count", hash(blob)), lambda: Counter(blob))


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > limit) of each whole text.

    The driver reads the vocabulary file and broadcasts it (a fixed file of 1.6 MB).
    """
    bound_batches(docs.sparkSession)
    with open(vocabulary_path, "rb") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())

    @arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array(_counter(shipped.value)(texts.to_pylist()), pa.int64())

    return (docs.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"))
            .withColumn("n_tokens", tokens(F.col(text)))
            .withColumn("over_limit", F.col("n_tokens") > limit))
