"""Connected components of an edge table, without bringing it to one place."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import land


SLICE = 1 << 18  # edges that one task joins up


def _forest(batches):
    """Each node of a slice of edges below the smallest node it is connected to there."""
    pairs = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches if b.num_rows]
    if not pairs:
        return
    nodes, ends = np.unique(np.concatenate(pairs), return_inverse=True)
    ends = ends.reshape(-1, 2)
    root = np.arange(len(nodes))
    while True:  # hang each tree below the smallest tree it touches, then halve all paths
        a, b = root[ends[:, 0]], root[ends[:, 1]]
        low = np.minimum(a, b)
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    at = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_pydict({"u": pa.array(nodes[at], pa.int64()), "v": pa.array(nodes[root[at]], pa.int64())})


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest node of each node's component: node, root.  Edges a, b (long); loops and repeats do no harm; no edges, no rows.

    First every slice of at most about SLICE edges is reduced to a forest in its own task, which is all there is to do when
    one slice holds everything.  Forests are joined by two alternating steps until nothing changes: every node hangs its larger
    neighbours on its smallest neighbour, then its smaller ones.  The smallest neighbour is an aggregate combined before
    the shuffle, so a hub with very many edges is one row per task there; the join behind it is split by adaptive execution.
    Every round is written to the shared folder.
    """
    now = land(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    slices = max(1, -(-now.count() // SLICE))
    now = land(now.repartition(slices).mapInArrow(_forest, "u long, v long"), "edges")
    before = None
    for _ in range(most_rounds if slices > 1 else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = land(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        mark = nxt.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if mark == before:
            break
        before, now = mark, nxt
    else:
        if slices > 1:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
