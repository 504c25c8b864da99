"""Graphs inside meshes, as edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import settle


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of the numbers below n that edges (a, b) connect with each. A round hooks every root to a smaller neighbour's and
    shortens all paths, so what is left of the roots at least halves in two rounds."""
    root = np.arange(n)
    while True:
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        open_ = high != low
        if not open_.any():
            return root
        np.minimum.at(root, high[open_], low[open_])
        while (shorter := root[root]).tobytes() != root.tobytes():
            root = shorter
        a, b = a[open_], b[open_]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mesh_id, a, b) -> (mesh_id, node, root): the least node that the edges of this partition connect with each of its nodes."""
    edges = [b.to_pandas() for b in batches if b.num_rows]
    for mesh_id, own in pd.concat(edges).groupby("mesh_id", sort=False) if edges else ():
        nodes, place = np.unique(own[["a", "b"]].to_numpy(np.int64).T, return_inverse=True)
        place = place.reshape(2, -1)
        root = nodes[roots_of(place[0], place[1], len(nodes))]
        yield pa.record_batch([pa.array(np.full(len(nodes), mesh_id, np.int64)), pa.array(nodes), pa.array(root)], names=["mesh_id", "node", "root"])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (mesh_id, node), edges (mesh_id, a, b) -> (mesh_id, node, root): root is the smallest node that can be reached.

    Edges are dealt by ranges of their ids, which are near where the faces are, and each part is contracted by itself. What is left
    are links between the roots of parts, from the nodes that several parts have; those alone go into rounds."""
    local = settle(edges.where("a <> b").select("mesh_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).repartitionByRange("mesh_id", "a").mapInArrow(_contracted, "mesh_id long, node long, root long"))
    least = settle(local.groupBy("mesh_id", "node").agg(F.min("root").alias("least"), F.max("root").alias("most")))
    several = least.where("least < most").select("mesh_id", "node", "least")
    links = local.join(several, ["mesh_id", "node"]).where("root <> least").select("mesh_id", F.col("root").alias("a"), F.col("least").alias("b"))
    linked = _stars(links).select("mesh_id", F.col("a").alias("least"), F.col("b").alias("root"))
    reached = least.select("mesh_id", "node", "least").join(linked, ["mesh_id", "least"], "left").select("mesh_id", "node", F.coalesce("root", "least").alias("root"))
    return nodes.join(reached, ["mesh_id", "node"], "left").select("mesh_id", "node", F.coalesce("root", "node").alias("root"))


def _stars(edges: DataFrame) -> DataFrame:
    """edges (mesh_id, a, b) -> (mesh_id, a, b): every node a that isn't the least of its component, and that one.

    Rounds of large-star and small-star: the number of rounds grows with the logarithm of the graph, the rows of a round
    stay below the edges, and a node with very many neighbours is an aggregate with one row on its side of the join."""
    now = settle(edges.select("mesh_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("mesh_id", "a", "b").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            return now
        mark = new
        both = now.select("mesh_id", F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("mesh_id", F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("mesh_id", "u").agg(F.min("v").alias("m")).select("mesh_id", "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, ["mesh_id", "u"]).where("v <> m").select("mesh_id", F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("mesh_id", "a").agg(F.min("b").alias("m"))
        moved = large.join(low, ["mesh_id", "a"]).where("b <> m").select("mesh_id", F.col("b").alias("a"), F.col("m").alias("b"))
        now = settle(moved.union(low.select("mesh_id", "a", F.col("m").alias("b"))).distinct())


def symmetric(dual: DataFrame) -> DataFrame:
    """Both directions of each edge (a, b, cost); parallel edges stay."""
    return dual.select("mesh_id", "a", "b", "cost").unionByName(dual.select("mesh_id", F.col("b").alias("a"), F.col("a").alias("b"), "cost"))


def shortest_paths(dual: DataFrame, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """sources (mesh_id, node) -> (mesh_id, node, dist), reached nodes only. Bellman-Ford; a round relaxes the changed nodes alone.

    It has the fixpoint of Dijkstra's algorithm bit for bit, as adding a positive cost is monotone."""
    edges = settle(symmetric(dual))
    dist = settle(sources.select("mesh_id", "node", F.lit(0.0).alias("dist")))
    front = dist
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        reached = front.withColumnRenamed("node", "a").join(edges, ["mesh_id", "a"]).select("mesh_id", F.col("b").alias("node"), (F.col("dist") + F.col("cost")).alias("new")).groupBy("mesh_id", "node").agg(F.min("new").alias("new"))
        merged = settle(dist.join(reached, ["mesh_id", "node"], "full").select("mesh_id", "node", F.least("dist", "new").alias("dist"), (F.col("dist").isNull() | (F.col("new") < F.col("dist"))).alias("changed")))
        dist, front = merged.drop("changed"), merged.where("changed").drop("changed")
        if not front.limit(1).count():
            break
    return dist
