"""Embedding near-dedup: random-hyperplane sign hashing, exact cosines, components.

Each table hashes a vector to the signs of its products with random planes; vectors that
share a code in some table are compared by their exact cosine in double precision. A pair
is compared and counted in the first table that joins it, so no list of pairs is ever made: a task
returns, for each vector of its bucket, how many it links with, and a forest of links.
Buckets are compared in blocks of bounded size, all blocks against all.

Equal vectors are compared once and counted as often as they occur. Null vectors, zero
vectors and vectors with null or non-finite components link with nothing, as do vectors
of different lengths with each other. Rows are never merged; a null id counts as larger
than any other when a component is named. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, join_hot
from ..shared import materialise
from .pieces import bound_batches

COSINE = 0.9
#: Chance that a pair at the least cosine meets in no table.
MISS = 0.0005
#: Vectors that share a code by chance; more vectors get longer codes and more tables.
BY_CHANCE = 64
SHORTEST_CODE = 10
BLOCK = 1000


def tables_for(vectors: int, cosine: float = COSINE) -> tuple[int, int]:
    """(bits of a code, number of tables) for so many different vectors."""
    bits = max(SHORTEST_CODE, math.ceil(math.log2(max(1, vectors) / BY_CHANCE)))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-same))


def _planes(width: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(20_240_229).standard_normal((width, bits * tables))


def _codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One int64 code per table; a row for each vector."""
    signs = (vectors @ _planes(vectors.shape[1], bits, tables)) > 0
    return signs.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def usable(embedding: str) -> Column:
    """Not null, no null or non-finite component, not zero."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _links(grouped, threshold: float):
    """On the rows (table, asks, rid, times, codes, vector) of two blocks: per vector its new links."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks, rid, times, number = (table[c].to_numpy(zero_copy_only=False) for c in ("asks", "rid", "times", "no"))
        widths = np.array(pyarrow.compute.list_value_length(table["vector"]).to_pylist())
        codes = np.array([np.frombuffer(c.as_py(), np.int64) for c in table["codes"]])
        count, src, dst, group = np.zeros(len(rid), np.int64), [], [], {}

        def root(x):
            while group.get(x, x) != x:
                group[x] = group.get(group[x], group[x])
                x = group[x]
            return x

        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            x = np.array([table["vector"][int(i)].as_py() for i in rows], np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            ask = np.flatnonzero(asks[rows])
            within = not (~asks[rows]).any()
            other = ask if within else np.flatnonzero(~asks[rows])
            # pairs that an earlier table joins were compared there
            fresh = np.ones((len(ask), len(other)), bool)
            for earlier in range(number[0]):
                fresh &= codes[rows[ask], earlier][:, None] != codes[rows[other], earlier]
                if not fresh.any():
                    break
            ask, fresh = ask[fresh.any(axis=1)], fresh[fresh.any(axis=1)]
            near = (x[ask] @ x[other].T >= threshold) & fresh
            for q in np.flatnonzero(near.any(axis=1)):
                a = rows[ask[q]]
                found = rows[other[near[q]]]
                found = found[rid[found] != rid[a]]
                if within:
                    count[a] += times[found].sum()
                else:
                    count[a] += times[found].sum()
                    count[found] += times[a]
                for b in found:
                    u, v = root(rid[a]), root(rid[b])
                    if u != v:
                        group[max(u, v)] = min(u, v)
                        src.append(u)
                        dst.append(v)
        some = np.flatnonzero(count)
        return pa.table({
            "rid": pa.array(np.concatenate((rid[some], np.array(src, np.int64))), pa.int64()),
            "n": pa.array(np.concatenate((count[some], np.zeros(len(src), np.int64))), pa.int64()),
            "dst": pa.array([None] * len(some) + dst, pa.int64()),
        })

    return grouped.applyInArrow(compare, "rid long, n long, dst long")


def link_embeddings(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable), kept."""
    bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(usable(embedding), F.col(embedding)).alias("vector"))
    # +0.0 makes the two zeros one, so equal vectors have equal keys
    key = F.when(F.col("vector").isNotNull(), F.sha2(F.to_binary(F.array_join(F.transform("vector", lambda v: (v + F.lit(0.0)).cast("string")), ","), F.lit("utf-8")), 256))
    rows = materialise(rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("same", key), "vectors")
    first = F.min(F.struct(F.isnull("vec_id").alias("n"), "vec_id", "rid"))
    distinct = rows.where("same is not null").groupBy("same").agg(first.alias("f"), F.count("*").alias("times"), F.first("vector").alias("vector"))
    distinct = materialise(distinct.select("same", "f.rid", "f.vec_id", "times", "vector"), "distinct")
    bits, tables = tables_for(distinct.count(), cosine)

    def hash_all(batches):
        for batch in batches:
            rid, times, flat = batch["rid"].to_numpy(), batch["times"].to_numpy(), batch["vector"]
            for width in np.unique(pyarrow.compute.list_value_length(flat).to_numpy()):
                at = np.flatnonzero(pyarrow.compute.list_value_length(flat).to_numpy() == width)
                x = np.array([flat[int(i)].as_py() for i in at], np.float64)
                codes = _codes(x, bits, tables)
                yield pa.RecordBatch.from_arrays([
                    pa.array(rid[at]), pa.array(times[at]), flat.take(pa.array(at)),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables), pa.array(codes.ravel())),
                ], ["rid", "times", "vector", "codes", "list"])

    element = dict(distinct.dtypes)["vector"]
    hashed = materialise(distinct.select("rid", "times", "vector").mapInArrow(hash_all, f"rid long, times long, vector {element}, codes binary, list array<long>"), "codes")
    keyed = hashed.select("rid", F.posexplode("list").alias("no", "code"))
    sizes = materialise(keyed.groupBy("no", "code").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), "sizes")
    placed = keyed.join(sizes, ["no", "code"]).withColumn("own", F.pmod(F.xxhash64("rid"), "parts").cast("int"))
    # a row for every pair of blocks that it is part of; the lower block asks
    placed = placed.withColumn("pair", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("rid", "no", "code", F.least("own", "pair").alias("one"), F.greatest("own", "pair").alias("two"), (F.col("own") <= F.col("pair")).alias("asks"))
    joined = placed.join(hashed.drop("list"), "rid")
    found = materialise(_links(joined.groupBy("no", "code", "one", "two"), cosine), "links")
    labels = connected_components(found.where("dst is not null").select(F.col("rid").alias("src"), "dst"))
    counts = found.where("dst is null").groupBy("rid").agg(F.sum("n").alias("n"))
    named = distinct.drop("vector").join(counts, "rid", "left").join(labels.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    named = materialise(named, "named")
    best = named.groupBy("component").agg(F.min(F.struct(F.isnull("vec_id").alias("n"), "vec_id")).alias("f"), F.count("*").alias("members"))
    classes = join_hot(named, best, "component", "members")
    classes = classes.select("same", "times", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.col("f.vec_id").alias("component_id"))
    out = join_hot(rows.select("vec_id", "same"), classes, "same", "times")
    alone = F.col("n_links").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
