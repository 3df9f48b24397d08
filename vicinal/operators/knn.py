"""Exact nearest-neighbour joins over integer vectors.

Neighbours are ordered by (squared distance, reference id), so that a result
does not depend on the order in which references are met.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_squared

RESULT = "query_id long, ref_id long, d2 long, ref_fraud boolean"


def squared_distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """All squared distances of int64 rows, by one matrix product: in float64 where that holds them exactly, else in int64."""
    most = float((q.astype(np.float64) ** 2).sum(1).max(initial=0) + (r.astype(np.float64) ** 2).sum(1).max(initial=0)) * 2
    a, b = (q.astype(np.float64), r.astype(np.float64)) if most < 2**53 else (q, r)
    return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)


def nearest_in_block(qid, q, qf, rid, r, rf, k: int, exclude_self: bool, opposite: bool):
    """The k nearest of one block of references for each query: query index, reference index, d2.

    Distances are exact while they fit 64-bit integers.
    """
    d = squared_distances(q, r)
    far = np.iinfo(np.int64).max
    if exclude_self:
        d[qid[:, None] == rid[None, :]] = far
    if opposite:
        d[qf[:, None] == rf[None, :]] = far
    kth = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), far)
    row, col = np.nonzero((d <= kth[:, None]) & (d < far))
    dist = d[row, col]
    order = np.lexsort((rid[col], dist, row))
    row, col, dist = row[order], col[order], dist[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], dist[keep]


def knn_join(queries: DataFrame, refs: DataFrame, k: int, exclude_self: bool = False, opposite: bool = False, strategy: str = "arrow", query_block: int = 2048, ref_block: int = 4096) -> DataFrame:
    """query_id, rank, ref_id, d2, ref_fraud: the k nearest references of each query.

    queries, refs: id (long, unique among the queries), q (array of long), f (boolean). exclude_self leaves
    out the reference with the query's id (leave one out), opposite those with
    the query's own label. "arrow" deals both sides to blocks of bounded size and
    takes a matrix product a pair of blocks; "sql" is the same join in built-in
    functions, as a readable twin.
    """
    best = Window.partitionBy("query_id").orderBy("d2", "ref_id")
    if strategy == "sql":
        cond = F.lit(True)
        if exclude_self:
            cond = cond & (F.col("a.id") != F.col("b.id"))
        if opposite:
            cond = cond & (F.col("a.f") != F.col("b.f"))
        pairs = queries.alias("a").join(refs.alias("b"), cond).select(F.col("a.id").alias("query_id"), F.col("b.id").alias("ref_id"), l2_squared(F.col("a.q"), F.col("b.q")).alias("d2"), F.col("b.f").alias("ref_fraud"))
    else:
        spread = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
        nq, nr = queries.count(), refs.count()
        qb, rb = max(1, math.ceil(nq / query_block)), max(1, math.ceil(nr / ref_block))
        named = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in ("id", "q", "f")], spread.alias("s"))
        left = named(queries, "q").select("qid", "qq", "qf", (F.col("s") % qb).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("rb"))
        right = named(refs, "r").select("rid", "rq", "rf", (F.col("s") % rb).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qb - 1).cast("long"))).alias("qb"))

        def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({"query_id": [], "ref_id": [], "d2": [], "ref_fraud": []}).astype({"query_id": "int64", "ref_id": "int64", "d2": "int64", "ref_fraud": "bool"})
            mat = lambda s: np.stack(s.to_numpy()).astype(np.int64)
            qid, rid, rf = a["qid"].to_numpy(), b["rid"].to_numpy(), b["rf"].to_numpy()
            row, col, d = nearest_in_block(qid, mat(a["qq"]), a["qf"].to_numpy(), rid, mat(b["rq"]), rf, k, exclude_self, opposite)
            return pd.DataFrame({"query_id": qid[row], "ref_id": rid[col], "d2": d, "ref_fraud": rf[col]})

        pairs = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(pair, RESULT)
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "ref_id", "d2", "ref_fraud")


def vote(neighbours: DataFrame) -> DataFrame:
    """query_id, fraud_count, kth_d2: votes of the neighbours and the distance of the last."""
    return neighbours.groupBy("query_id").agg(F.sum(F.col("ref_fraud").cast("int")).cast("int").alias("fraud_count"), F.max("d2").alias("kth_d2"))


def verdict(votes: DataFrame, k: int = 5) -> DataFrame:
    """votes with approved (fewer than three fifths of k votes) and fraud_score (votes / k)."""
    return votes.withColumn("approved", F.col("fraud_count") * 5 < 3 * k).withColumn("fraud_score", F.col("fraud_count") / F.lit(float(k)))


def nearest_opposite(refs: DataFrame) -> DataFrame:
    """id, opp_d2: squared distance to the nearest reference of the other label, in one pass."""
    return knn_join(refs, refs, 1, opposite=True).select(F.col("query_id").alias("id"), F.col("d2").alias("opp_d2"))
