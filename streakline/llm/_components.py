"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c


class UnionFind:
    """Smallest member as the root; for the bounded sets that one task holds."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def local_forest(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: a spanning forest of each Arrow batch's edges (a, b); no link between parts is lost."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            uf = UnionFind()
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                uf.union(x, y)
            nodes = np.fromiter(uf.parent, np.int64, len(uf.parent))
            roots = np.fromiter(map(uf.find, nodes.tolist()), np.int64, len(nodes))
            keep = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for each id of ``edges`` (two long columns) that is not its component's smallest id.

    Each round ends in a checkpoint; rounds stop when no edge changes.  Every step
    is a join or a partial aggregation on node ids, so a node with very many edges
    is split by the adaptive skew join."""
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    e = c.checkpoint(local_forest(pairs).distinct())
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(roots, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(roots.select("u", F.col("m").alias("v")))
        e = c.checkpoint(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now
    raise RuntimeError("components did not settle")
