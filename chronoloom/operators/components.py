"""Connected components of a distributed edge list.

Each round hooks every label to its smallest neighbour, halves the chains that this
makes, and contracts the edges to those between different labels. Contracted edges at
least halve the labels of every component, so the rounds grow with the logarithm of its
size. Rounds are cut by writing them to the shared folder; the only thing the driver
sees is a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import forget, materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Edges are undirected; loops and repeats change nothing; edges with a null end are
    ignored; a node on a loop only is its own component. An empty list gives no rows.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    left = pairs.where("a < b")
    while not left.isEmpty():
        ends = left.select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("a").alias("y")), F.struct(F.col("a").alias("x"), F.col("b").alias("y")))).alias("e")).select("e.x", "e.y")
        hooks = materialise(ends.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("p")), "hooks")
        up = hooks.select(F.col("x").alias("p"), F.col("p").alias("q"))
        jumped = materialise(hooks.join(up, "p", "left").select("x", F.coalesce("q", "p").alias("p")), "jumps")
        new = materialise(labels.join(jumped, labels.component == jumped.x, "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        one = jumped.select(F.col("x").alias("a"), F.col("p").alias("pa"))
        two = jumped.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        moved = left.join(one, "a").join(two, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        moved = materialise(moved, "edges")
        for old in (labels, pairs, hooks, jumped):
            forget(old)
        labels, pairs, left = new, moved, moved
    return labels


def join_hot(rows: DataFrame, table: DataFrame, key: str, times: str, share: float = 0.001) -> DataFrame:
    """``rows`` left join ``table`` on ``key``, of which ``table`` holds one row each.

    ``times`` is the column of ``table`` that counts the rows with the key, and is dropped.
    Keys with at least ``share`` of all rows, so 1 / ``share`` of them at most, are
    broadcast; the rows of the others are shuffled, so no key brings more than that share of
    the rows into one task.
    """
    table = materialise(table, "keyed")
    total = table.agg(F.sum(times).alias("n")).first().n or 0
    hot = table.where(F.col(times) >= max(1.0, share * total)).drop(times)  # 1 / share rows at most
    rest = table.where(F.col(times) < max(1.0, share * total)).drop(times)
    of_hot = rows.join(F.broadcast(hot), key)
    return rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "left").unionByName(of_hot)
