"""Exact k best inner products by a dual traversal of cover trees over blocks of queries and blocks of vectors."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import land

LEAF = 48
AHEAD = 64      # centres that are measured at once
FEW = 8         # children of fewer rows stay rows of their parent


class CoverTree:
    """Nodes over rows of ``x``: a centre, its norm, the distance of its farthest row, a slice of ``order``, and children.

    A node at scale s holds rows within 2**s of its centre.  Its children's centres are more than 2**(s-1) apart and each child holds
    rows within 2**(s-1) of its centre, so every step down halves the radius.  Equal rows end in one leaf.  Children of fewer than
    FEW rows are not worth a node: their rows together are one leaf of their parent, about the parent's centre; rows without any
    structure make one such leaf.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.order = np.arange(len(x))
        self.nodes = []  # [centre, norm, radius, first, last, children]
        if len(x):
            self._build(leaf)
        pick = lambda k: np.array([n[k] for n in self.nodes])
        self.centres, self.norms, self.radii = pick(0), pick(1), pick(2)
        size = np.sqrt(np.einsum("ij,ij->i", x, x))
        self.longest = np.array([size[self.order[n[3]:n[4]]].max() for n in self.nodes])  # norm of a node's longest row

    def _build(self, leaf):
        """Iteratively: a stack of slices of ``order`` whose first row is the centre (None) or whose centre is given."""
        stack, square = [(0, len(self.x), None, None)], np.einsum("ij,ij->i", self.x, self.x)
        while stack:
            a, b, parent, centre = stack.pop()
            rows, loose = self.order[a:b], centre is not None
            if not loose:
                centre = self.x[rows[0]]
            gap = self.x[rows] - centre
            dist = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            radius = float(dist.max())
            me = len(self.nodes)
            self.nodes.append([centre, float(np.sqrt(centre @ centre)), radius, a, b, []])
            if parent is not None:
                self.nodes[parent][5].append(me)
            if loose or b - a <= leaf or radius == 0.0:
                continue
            half = 2.0 ** (np.ceil(np.log2(radius)) - 1)
            groups, left = [rows[dist <= half]], rows[dist > half]
            while len(left):  # the first rows left become centres in turn, unless an earlier one is near; AHEAD of them are measured at once
                x, ahead = self.x[left], min(AHEAD, len(left))
                near = square[left][:, None] + square[left[:ahead]] - 2 * (x @ x[:ahead].T) <= half * half
                free = np.ones(len(left), bool)
                for c in range(ahead):
                    if free[c]:
                        mine = near[:, c] & free
                        mine[c] = True
                        free &= ~mine
                        groups.append(left[mine])
                left = left[free]
            at = a
            for g in groups:
                if len(g) >= FEW:
                    self.order[at:at + len(g)] = g
                    stack.append((at, at + len(g), me, None))
                    at += len(g)
            if at < b:
                self.order[at:b] = np.concatenate([g for g in groups if len(g) < FEW])
                stack.append((at, b, me, centre))


def dual_search(queries: np.ndarray, data: np.ndarray, ids: np.ndarray, own: np.ndarray, rows: np.ndarray, k: int):
    """For each query the ``k`` best rows of ``data`` by inner product, ties to the smaller id, without the query's own row;
    and how many products were computed.

    A pair of nodes is dropped when no inner product between them can reach the worst k-th score in the query node:
    q.p <= cq.cp + rq |cp| + rp |cq| + rq rp, and <= (|cq| + rq) max |p|.  At a leaf of queries each query has a bound of its own
    (rq = 0), and only those that the data node may still serve go on.
    """
    best = np.full((len(queries), k), -np.inf)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    if not len(queries) or not len(data):
        return best, best_id, 0
    qt, dt = CoverTree(queries, 16), CoverTree(data)
    norm = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    worst, computed = np.full(len(qt.nodes), -np.inf), 0

    def reach(a, b):
        """What each query of the leaf ``a`` (or the node ``a`` as a whole) can score at most in each data node of ``b``."""
        n = qt.nodes[a]
        if n[5]:
            v = dt.centres[b] @ n[0] + n[2] * dt.norms[b] + dt.radii[b] * n[1] + n[2] * dt.radii[b]
            v = np.minimum(v, (n[1] + n[2]) * dt.longest[b])[None]
        else:
            q = qt.order[n[3]:n[4]]
            v = np.minimum(queries[q] @ dt.centres[b].T + norm[q, None] * dt.radii[b], norm[q, None] * dt.longest[b])
        return v + 1e-9 * np.abs(v) + 1e-6

    def known(a):
        """The k-th scores that ``a``'s queries have to beat, one for the whole node unless it is a leaf."""
        n = qt.nodes[a]
        if n[5]:
            worst[a] = max(worst[a], min(worst[c] for c in n[5]))
            return worst[a:a + 1]
        kth = best[qt.order[n[3]:n[4]], k - 1]
        worst[a] = kth.min()
        return kth

    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        qn, dn = qt.nodes[a], dt.nodes[b]
        live = reach(a, [b])[:, 0] >= known(a)
        if not live.any():
            continue
        if not qn[5] and not dn[5]:
            q, d = qt.order[qn[3]:qn[4]][live], dt.order[dn[3]:dn[4]]
            s = queries[q] @ data[d].T
            computed += s.size
            s[own[q][:, None] == rows[d][None, :]] = -np.inf
            hit = np.flatnonzero((s >= best[q, k - 1][:, None]).any(1))
            if len(hit):
                all_s = np.concatenate([best[q[hit]], s[hit]], 1)
                all_i = np.concatenate([best_id[q[hit]], np.broadcast_to(ids[d], (len(hit), len(d)))], 1)
                # equal scores go to the smaller id
                pick = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                best[q[hit]] = np.take_along_axis(all_s, pick, 1)
                best_id[q[hit]] = np.take_along_axis(all_i, pick, 1)
        elif dn[5] and (not qn[5] or dn[2] * qn[1] >= qn[2] * dn[1]):
            v = reach(a, dn[5])
            may = np.where(v >= known(a)[:, None], v, -np.inf).max(0)
            stack.extend((a, dn[5][c]) for c in np.argsort(may, kind="stable") if may[c] > -np.inf)  # the most promising pair is taken first
        else:
            stack.extend((c, b) for c in sorted(qn[5], key=lambda c: float(reach(c, [b]).max())))
    return best, best_id, computed


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of unequal length end in zeros: a component that one side lacks adds nothing to a product."""
    flat, cut = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    length = np.diff(cut)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), length), np.arange(cut[-1] - cut[0]) - np.repeat(cut[:-1] - cut[0], length)] = flat[cut[0]:cut[-1]]
    return out


def top_inner_products(vectors: DataFrame, is_query, key: str = "vec_id", embedding: str = "embedding", k: int = 5, scale: int = 256, data_block: int = 8192, query_block: int = 2048) -> DataFrame:
    """``k`` highest integer inner products of every query row with all other rows: query_id, rank, vec_id, score.

    ``is_query``: condition on the key column.  Components become floor(scale * x).  Queries and rows are dealt into
    blocks; each pair of blocks is one task's work, which builds a cover tree over either side and walks both together.
    A task holds ``data_block + query_block`` rows; the pairs of blocks grow with queries times rows, as the question does.

    Null vectors and vectors with a null or non-finite component take no part; an empty vector has product 0 with every
    other.  Vectors of unequal length are compared as if the shorter ended in zeros.  A null key is never a query and is
    no candidate.  Rows that share a key are separate rows: each is a candidate of the others, and each asks its own
    question.  Scores beyond the range of long are set to its ends.  Other columns are ignored.
    """
    whole = F.forall(F.col(embedding), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    slim = vectors.where(F.col(key).isNotNull() & F.col(embedding).isNotNull()).where(F.coalesce(whole, F.lit(False)))
    slim = land(slim.select(F.col(key).cast("long").alias("vid"), F.transform(F.col(embedding), lambda v: v.cast("double")).alias("x")).withColumn("uid", F.monotonically_increasing_id()), "search-rows")
    asks = F.coalesce(is_query(F.col("vid")), F.lit(False))
    n, nq, width, peak = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum(asks.cast("int")), F.lit(0)), F.max(F.size("x")), F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))).first()
    schema = "quid long, query_id long, vec_id long, score long"
    spark = vectors.sparkSession
    if not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts, askers = -(-n // data_block), -(-nq // query_block)
    exact = ((peak or 0.0) * scale + 1) ** 2 * max(width, 1) < 2.0 ** 53
    deal = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "uid"), F.lit(m)).cast("int")
    data = slim.select("*", deal(1, parts).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(askers - 1))).alias("q"), F.lit(False).alias("asks"))
    queries = slim.where(asks).select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("d"), deal(2, askers).alias("q"), F.lit(True).alias("asks"))

    def cell(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        v = np.floor(_matrix(table.column("x").combine_chunks(), width or 0) * scale)
        side, ids, uid = (table.column(c).to_numpy() for c in ("asks", "vid", "uid"))
        q, d = np.flatnonzero(side), np.flatnonzero(~side)
        if exact:
            s, i, _ = dual_search(v[q], v[d], ids[d], uid[q], uid[d], k)
        else:  # products beyond 2**53: whole numbers of any length, every pair
            s, i = _long_products(v[q], v[d], ids[d], uid[q], uid[d], k)
        have = np.isfinite(s) if exact else i != np.iinfo(np.int64).max
        at = np.nonzero(have)
        return pa.table({"quid": uid[q][at[0]], "query_id": ids[q][at[0]], "vec_id": i[at], "score": s[at].astype(np.int64)}, schema=pa.schema([(c, pa.int64()) for c in ("quid", "query_id", "vec_id", "score")]))

    cells = data.unionByName(queries).groupBy("q", "d").applyInArrow(cell, schema)
    by = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id")  # k rows per block and query
    return cells.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _long_products(q, d, ids, own, rows, k):
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    out, out_id = np.zeros((len(q), k), np.int64), np.full((len(q), k), high)
    whole = [[int(c) for c in v] for v in d]
    for a, v in enumerate(q):
        v = [int(c) for c in v]
        scored = sorted((-sum(s * t for s, t in zip(v, w, strict=True)), int(i)) for w, i, r in zip(whole, ids, rows, strict=True) if r != own[a])[:k]
        for j, (s, i) in enumerate(scored):
            out[a, j], out_id[a, j] = min(max(-s, low), high), i
    return out, out_id
