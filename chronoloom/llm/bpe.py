"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece there is exactly one last token with which a valid
encoding of that prefix ends. A token ``t`` that is a suffix of the prefix is that
last token when what precedes it ends with a token ``s`` such that BPE leaves the
pair ``s t`` alone. Storing one token per prefix encodes a piece in one pass, makes
appends exact, and confines the work after an edit to its neighbourhood.

Rows with null text encode as the empty list. An output column replaces an input
column of the same name; all other columns pass through.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .pieces import BYTE_LEVEL, Bounded, bound_batches, resident, splitter

PIECES_KEPT = 200_000
PAIRS_KEPT = 400_000
#: Two token numbers share one key.
SHIFT = 1 << 24
#: A longer piece (in bytes) has a table of its own and is not remembered.
LONGEST_KEPT = 256


class Vocabulary:
    """Token bytes by rank, with the lookups that the dynamic programme needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        tails: dict[bytes, int] = dict.fromkeys((t[k:] for t in ranks for k in range(len(t))), -1)
        tails.update(ranks)
        self.tails = tails  # every suffix of a token; the token's rank, or -1
        self._edges = Bounded(self._edge, 2 * len(ranks) + 1)
        self._stays = Bounded(self._pair_stays, PAIRS_KEPT)

    @classmethod
    def from_tiktoken(cls, blob: bytes) -> Vocabulary:
        fields = (line.split() for line in blob.splitlines() if line.strip())
        return cls({base64.b64decode(a): int(b) for a, b in fields})

    def merge(self, data: bytes) -> list[int]:
        """BPE by its definition: join the lowest-ranked adjacent pair until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                return [self.ranks[p] for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _halves(self, data: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that BPE joins last to form a token; None for one byte or an unreachable token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                return None
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _edge(self, key: tuple[int, int]) -> list[tuple[bytes, float]] | None:
        """What stands at one edge of a token while it is built: (bytes, rank of the join that ends it).

        The key is the token and the side (0: its left edge, 1: its right edge).
        """
        token, side = key
        data, ends, out = self.tokens[token], float("inf"), []
        while len(data) > 1:
            halves = self._halves(data)
            if halves is None:
                return None
            out.append((data, ends))
            data, ends = halves[side], self.ranks[data]
        return [*out, (data, ends)][::-1]

    def _pair_stays(self, key: int) -> bool:
        """Whether BPE keeps the border between two tokens, or accepts one at the start.

        No join across the border may come before the joins that end its two neighbours;
        of equal ranks the leftmost join comes first.
        """
        before, token = divmod(key, SHIFT)
        right = self._edges[token, 0]
        if before < 0 or right is None:
            return right is not None
        left = self._edges[before, 1]
        if left is None:
            return False
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            across = self.ranks.get(x + y)
            if across is not None and across < x_ends and across <= y_ends:
                return False
            if x_ends == y_ends == float("inf"):
                return True
            if x_ends <= y_ends:
                i += 1
            if y_ends <= x_ends:
                j += 1

    def last_tokens(self, data: bytes, last: list[int]) -> None:
        """Extend ``last`` by the last tokens of the prefixes of ``data`` that it lacks."""
        tail, stays, longest = self.tails.get, self._stays, self.longest
        for end in range(len(last) + 1, len(data) + 1):
            fitting, start, least = [], end - 1, max(0, end - longest)
            while start >= least and (token := tail(data[start:end])) is not None:
                if token >= 0:
                    fitting.append((start, token))
                start -= 1
            for start, token in reversed(fitting):
                if stays[(last[start - 1] if start else -1) * SHIFT + token]:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")

    def read_back(self, last: list[int]) -> list[int]:
        """The encoding that the last tokens of all prefixes spell out."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]


class PrefixTable:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.last_tokens(self.data, self.last)

    def splice(self, start: int, stop: int, new: bytes) -> int:
        """Replace ``data[start:stop]``; returns how many prefixes were computed anew.

        A prefix's token depends on the last ``longest`` bytes and tokens only, so
        that many unchanged tokens in a row end the work.
        """
        tail, old = self.data[stop:], self.last[stop:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(new)
        same = k = 0
        while k < len(tail) and same < self.vocabulary.longest:
            self.append(tail[k : k + 1])
            same = same + 1 if self.last[-1] == old[k] else 0
            k += 1
        self.data += tail[k:]
        self.last += old[k:]
        return len(new) + k

    def ids(self) -> list[int]:
        return self.vocabulary.read_back(self.last)


class BatchTable:
    """The prefix tables of many pieces at once.

    Position by position, all pieces look up the tokens that end there in a trie of
    reversed tokens, shortest first, and keep the one that follows the prefix before it.
    """

    CACHE = 1 << 21

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        number = {b"": 0} | {t: i for i, t in enumerate(vocabulary.tails, 1)}
        inner = {t[1:] for t in vocabulary.tails}
        row = {t: i for i, t in enumerate(sorted(inner))}
        self.row = np.full(len(number), -1, np.int32)
        for t, i in row.items():
            self.row[number[t]] = i
        self.step = np.full((len(row), 256), -1, np.int32)
        self.token = np.full(len(number), -1, np.int32)
        for t, rank in vocabulary.tails.items():
            self.step[row[t[1:]], t[0]] = number[t]
            self.token[number[t]] = rank
        self.length = np.zeros(max(vocabulary.tokens, default=0) + 1, np.int32)
        for rank, t in vocabulary.tokens.items():
            self.length[rank] = len(t)
        self.bytes = np.frombuffer(b"".join(vocabulary.tokens.get(i, b"") for i in range(len(self.length))), np.uint8)
        self.begin = np.concatenate(([0], np.cumsum(self.length, dtype=np.int64)[:-1]))
        # a pair's verdict may be overwritten by another pair's; it is then asked for again
        self.known = np.full(self.CACHE, -(1 << 62), np.int64)
        self.stays = np.zeros(self.CACHE, bool)

    def _follows(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        key = before.astype(np.int64) * SHIFT + token
        slot = ((key * 0x9E3779B1) >> 8) & (self.CACHE - 1)
        new = np.flatnonzero(self.known[slot] != key)
        out = self.stays[slot]
        if len(new):
            memo = self.vocabulary._stays
            out[new] = [memo[k] for k in key[new].tolist()]
            self.known[slot[new]], self.stays[slot[new]] = key[new], out[new]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The encoding of each piece, as the bytes of its int32 ids; pieces are not empty."""
        if not pieces:
            return []
        size = np.array([len(p) for p in pieces])
        order = np.argsort(-size, kind="stable")
        ordered = size[order]
        start = np.concatenate(([0], np.cumsum(ordered)[:-1]))
        flat = np.frombuffer(b"".join([pieces[i] for i in order.tolist()]), np.uint8)
        last = np.full(len(flat), -1, np.int32)
        for at in range(int(ordered[0])):
            todo = start[: np.searchsorted(-ordered, -at)]
            node = np.zeros(len(todo), np.int32)
            for width in range(1, at + 2):
                row = self.row[node]
                node = np.where(row >= 0, self.step[row, flat[todo + (at - width + 1)]], -1)
                going = node >= 0
                token = np.where(going, self.token[node], -1)
                mine = np.flatnonzero(token >= 0)
                if len(mine):
                    before = last[todo[mine] + (at - width)] if width <= at else np.full(len(mine), -1, np.int32)
                    found = mine[self._follows(before, token[mine])]
                    last[todo[found] + at] = token[found]
                    going[found] = False
                todo, node = todo[going], node[going]
                if not len(todo):
                    break
        # read back from the ends, one token of every piece at a time
        owners, tokens, left, which = [], [], ordered.copy(), np.arange(len(ordered))
        while len(which):
            token = last[start[which] + left[which] - 1]
            owners.append(which)
            tokens.append(token)
            left[which] -= self.length[token]
            which = which[left[which] > 0]
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        turn = np.repeat(np.arange(len(owners)), [len(o) for o in owners])
        data = token[np.lexsort((-turn, owner))].tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(pieces)))).tolist()
        out, begin = [b""] * len(pieces), 0
        for i, end in zip(order.tolist(), ends):
            out[i] = data[begin:end]
            begin = end
        return out


class Codec:
    """Encodes whole texts piece by piece, with a bounded memo, and decodes ids.

    The memo has two generations: when the younger is full it becomes the older, and what
    is used again moves back, so frequent pieces are never forgotten.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str = BYTE_LEVEL):
        self.vocabulary, self.split, self.table = vocabulary, splitter(pattern), BatchTable(vocabulary)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _one(self, data: bytes) -> bytes:
        last: list[int] = []
        self.vocabulary.last_tokens(data, last)
        return np.array(self.vocabulary.read_back(last), np.int32).tobytes()

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Encodings of new pieces: whole tokens, short ones together, long ones on their own."""
        found, short = {}, []
        for piece in pieces:
            again = self.old.get(piece)
            if again is not None:
                found[piece] = again
                continue
            data = piece.encode()
            whole = self.vocabulary.ranks.get(data)
            if whole is not None:
                found[piece] = np.int32(whole).tobytes()
            elif len(data) > LONGEST_KEPT:
                found[piece] = self._one(data)
            else:
                short.append((piece, data))
        found.update(zip((p for p, _ in short), self.table.encode([d for _, d in short])))
        return found

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        out, k = [], 0
        while k < len(texts):
            block, held = [], 0
            while k < len(texts) and held < 300_000:
                block.append(self.split(texts[k] or ""))
                held += len(block[-1])
                k += 1
            memo = self.young
            new = set().union(*block).difference(memo)
            # pieces that are too long to be kept are added for this block only
            found = self._learn(new)
            memo.update(found)
            out += [np.frombuffer(b"".join(map(memo.__getitem__, pieces)), np.int32) for pieces in block]
            for piece in found:
                if len(piece) > LONGEST_KEPT:
                    del memo[piece]
            if len(memo) > PIECES_KEPT:
                self.old, self.young = memo, {}
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of many lists of ids that lie one after another, and where each list ends."""
        table = self.table
        length = table.length[ids].astype(np.int64)
        upto = np.cumsum(length)
        # byte k of the result is byte k - start of its token
        place = np.repeat(table.begin[ids] - (upto - length), length) + np.arange(length.sum())
        return table.bytes[place], np.concatenate(([0], upto))[ends]

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, np.int32)
        return self.decode_all(ids, np.array([len(ids)]))[0].tobytes()


def _codec(blob: bytes, pattern: str) -> Codec:
    return resident(("bpe", hash(blob), pattern), lambda: Codec(Vocabulary.from_tiktoken(blob), pattern))


def codec_columns(spark: SparkSession, ranks_path: str, pattern: str = BYTE_LEVEL):
    """Two functions on columns: text to ``array<int>``, and ids to ``binary``.

    The driver reads the vocabulary file and broadcasts it: its size is that of a
    fixed file (under 1 MB), whatever the corpus.
    """
    bound_batches(spark)
    with open(ranks_path, "rb") as file:
        shipped = spark.sparkContext.broadcast(file.read())

    @arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        codec = _codec(shipped.value, pattern)
        rows = codec.encode_all(texts.to_pylist())
        ends = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) for r in rows], out=ends[1:])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    @arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        codec = _codec(shipped.value, pattern)
        ends = np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
        data, ends = codec.decode_all(ids.flatten().to_numpy(zero_copy_only=False), ends)
        if len(data) >= 1 << 31:
            raise ValueError("a batch decodes to more than 2 GB: lower spark.sql.execution.arrow.maxRecordsPerBatch")
        return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])

    return encode, decode


def encode_documents(docs: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text; null and empty texts give an empty list."""
    encode, _ = codec_columns(docs.sparkSession, ranks_path)
    return docs.withColumn(ids, encode(F.col(text)))


def decode_documents(docs: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the ids stand for."""
    _, decode = codec_columns(docs.sparkSession, ranks_path)
    return docs.withColumn(out, decode(F.col(ids)))


def ids_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
