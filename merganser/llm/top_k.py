"""Exact top-k by inner product with a pivot table.

Vectors become integers, floor(scale * x). For integers q and v the squared distance is |q|^2 + |v|^2 - 2 <q, v>, so a lower bound of the distance is an
upper bound of the product. The table holds each vector's distances to many pivots, chosen far apart. Of two vectors of which only these distances are known, the least distance
they can have is that of their places among the pivots: the distances fix where a vector lies in the pivots' span, and how far from it, and the bound is |difference within the span|^2 + (difference of
the distances from it)^2. That is the greatest lower bound there is, never below the largest difference of two distances to one pivot, which tells little where vectors have no clusters.

Candidates of a block are evaluated in the order of their bounds, in slices, until the k-th best product so far is above every bound left: no later candidate can enter, nor tie.

Queries are the rows whose id is divisible by `every`, a stated set; they and all rows are packed into blocks, and each pair of blocks gives
each query's k best there. The k best of those are the result: what leaves a block is k rows a query, whatever its size.

Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id. Shorter vectors are extended with zeros.
A query's own row is every row of the same id. Repeated rows of other ids count one by one. Fewer candidates than k give fewer ranks; an empty table gives no rows.
Components beyond 2^40 / scale are held at that bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merganser.llm.shared import SALTS, map_batches, per_batch, staged

#: Pivots, and the rows they are chosen among, those of the smallest hash of their id: the pivots set what is saved, never the result.
PIVOTS, CHOICE = 64, 2_000
#: Queries and candidates of a block.
QUERIES, CANDIDATES = 2048, 8192
#: Queries whose bounds are made at once, and candidates of a slice.
SOME, SLICE = 64, 64


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): vectors that take part, as integers."""
    v = F.col(vector_col).cast("array<double>")
    bound = float(1 << 40)
    fit = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(bound)), F.lit(-bound))))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.when(v.isNotNull() & fit, ints).alias("v")).filter("id is not null and v is not null")


def packed(rows: DataFrame, name: str, size: int, dim: int) -> DataFrame:
    """Rows in blocks of about `size`: (name, ids, vectors), the vectors row by row as 64-bit floats."""
    count = rows.count()
    blocks = max(1, -(-count // size))

    def pack(batches):
        for batch in batches:
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            m = np.zeros((len(ids), dim))
            ends = np.cumsum([0, *(len(x) for x in lists)])
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            for i in range(len(ids)):
                m[i, : ends[i + 1] - ends[i]] = flat[ends[i] : ends[i + 1]]
            block = batch.column(0).to_numpy()
            for b in np.unique(block):
                at = block == b
                yield pa.RecordBatch.from_pydict({name: pa.array([int(b)], pa.int32()), "ids": pa.array([ids[at].astype(np.int64).tobytes()], pa.binary()), "m": pa.array([m[at].tobytes()], pa.binary())})

    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v").repartition(blocks, "block").sortWithinPartitions("block")
    parts = map_batches(dealt, pack, f"{name} int, ids binary, m binary")
    return parts


class Pivots:
    """Pivots, and the frame of their span: the first is its origin."""

    def __init__(self, among: np.ndarray, n: int):
        chosen: list[int] = []
        far = (among * among).sum(axis=1)
        while len(chosen) < min(n, len(among)) and far.max() > 0:
            chosen.append(int(np.argmax(far)))
            from_last = ((among - among[chosen[-1]]) ** 2).sum(axis=1)
            far = np.minimum(far, from_last) if len(chosen) > 1 else from_last
        self.points = among[chosen] if chosen else np.zeros((1, among.shape[1]))
        edges = self.points[1:] - self.points[0]
        u, sizes, _ = np.linalg.svd(edges, full_matrices=False)
        kept = sizes > 1e-6 * sizes.max(initial=0)
        self.squares = (edges * edges).sum(axis=1)
        #: From products with the edges to places in the frame.
        self.frame = u[:, kept] / sizes[kept]

    def distances(self, v: np.ndarray) -> np.ndarray:
        """The pivot table of vectors: squared distances."""
        return np.maximum((v * v).sum(axis=1)[:, None] + (self.points * self.points).sum(axis=1) - 2 * (v @ self.points.T), 0)

    def places(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where vectors lie in the span, and how far from it, by their distances alone."""
        at = ((table[:, :1] - table[:, 1:] + self.squares) / 2) @ self.frame
        return at, np.sqrt(np.maximum(table[:, 0] - (at * at).sum(axis=1), 0))


def best_of(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, pivots: Pivots, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query ids, vector ids and products of each query's k best in the block, and how many products were made."""
    qq, vv = (q * q).sum(axis=1), (v * v).sum(axis=1)
    (q_at, q_off), (v_at, v_off) = (pivots.places(pivots.distances(x)) for x in (q, v))
    # Rounding of a vanishing distance from the span weighs as the root of the machine precision.
    slack = 1e-5 * (qq.max(initial=1) + vv.max(initial=1) + (pivots.points**2).sum(axis=1).max())
    v_part = vv - (v_at * v_at).sum(axis=1)
    out, made = [], 0
    for at in range(0, len(q), SOME):
        some = slice(at, at + SOME)
        bounds = q_at[some] @ v_at.T
        bounds += ((qq[some] - (q_at[some] ** 2).sum(axis=1))[:, None] + v_part - (q_off[some, None] - v_off) ** 2) / 2 + slack
        for bound, own, x in zip(bounds, q_ids[some], q[some]):
            bound[v_ids == own] = -np.inf
            best_ids, best = np.empty(0, np.int64), np.empty(0)
            while True:
                # The slice of the highest bounds that are left; those below the k-th best can't enter.
                todo = np.flatnonzero(bound >= best[-1]) if len(best) == k else np.flatnonzero(bound > -np.inf)
                if not len(todo):
                    break
                if len(todo) > SLICE:
                    todo = todo[np.argpartition(-bound[todo], SLICE)[:SLICE]]
                made += len(todo)
                bound[todo] = -np.inf
                ids, scores = np.concatenate([best_ids, v_ids[todo]]), np.concatenate([best, v[todo] @ x])
                by = np.lexsort((ids, -scores))[:k]
                best_ids, best = ids[by], scores[by]
            out.append((np.full(len(best), own), best_ids, best))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), 0
    return (*(np.concatenate(x) for x in zip(*out)), made)


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """One row for each query and rank: query_id, rank (from 1), vec_id, score. Higher products first, ties to the smaller id."""
    rows = staged(whole(vectors, id_col, vector_col, scale))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    queries = rows.filter(F.col("id") % every == 0).dropDuplicates(["id"])
    q_blocks = staged(packed(queries, "qb", QUERIES, dim))
    v_blocks = packed(rows, "vb", CANDIDATES, dim)
    chosen = rows.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(CHOICE).collect()
    among = np.zeros((len(chosen), dim))
    for i, r in enumerate(chosen):
        among[i, : len(r.v)] = r.v
    pivots = Pivots(among, PIVOTS) if len(among) else None
    numbers = [r.qb for r in q_blocks.select("qb").distinct().orderBy("qb").collect()] or [0]
    # Pairs of blocks are dealt out by both numbers, so that one block of queries is no single task.
    salts = F.array(*map(F.lit, range(SALTS)))
    sides = v_blocks.select(F.explode(F.array(*map(F.lit, numbers))).alias("qb"), F.pmod("vb", F.lit(SALTS)).alias("salt"), F.col("ids").alias("v_ids"), F.col("m").alias("v"))
    pairs = sides.join(q_blocks.select("qb", F.explode(salts).alias("salt"), F.col("ids").alias("q_ids"), F.col("m").alias("q")), ["qb", "salt"])

    def make():
        def work(batch: pa.RecordBatch):
            for v_ids, v, q_ids, q in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                array = lambda x: np.frombuffer(x).reshape(-1, dim)
                qi, vi, s, _ = best_of(np.frombuffer(q_ids, np.int64), array(q), np.frombuffer(v_ids, np.int64), array(v), pivots, k)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(qi, pa.int64()), "vec_id": pa.array(vi, pa.int64()), "score": pa.array(s.astype(np.int64))})

        return work

    local = map_batches(pairs.select("qb", "v_ids", "v", "q_ids", "q"), per_batch(make), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
