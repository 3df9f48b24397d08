"""Exact top-k inner-product search by no-random-access aggregation.

Every dimension of a block of candidates is a list sorted by component. The
queries of a block read all lists in step, each list from the end that the
query's own weight favours, one stretch of entries after the other, half of what
is left. What a stretch shows is added to the candidates' lower bounds, in which
a list that has not shown a candidate counts with its worst value; the upper
bound has the value at which that list now stands instead. A query stops reading
when none but a few times k candidates can still reach the k-th lower bound; the
exact scores of these finalists are then resolved, and ties go to the smaller id.

Queries and candidates are dealt to blocks of bounded size; each pair of a query
block and a candidate block is one small task, and the k best of each query are
merged over its candidate blocks. Exactness asks that every candidate meets every
block of queries: candidates travel once for each of these. Where vectors have
many dimensions and no structure, bounds stay wide, and queries read most of the
lists before they stop; `depth` in the result says how much.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialise

#: A query stops reading when so many times k candidates at most are left.
FINALISTS = 4


def _score_type(q: np.ndarray, x: np.ndarray) -> type:
    """The cheapest type in which every partial sum of a product is exact."""
    most = float(np.abs(q).sum(axis=1).max(initial=0)) * float(np.abs(x).max(initial=0))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def nra_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of one block for each query: query index, candidate index, score, depth.

    q, x: int64 matrices. A candidate with the query's own id takes no part.
    depth: the share of the lists that the query had read when it stopped.
    Scores are exact while they fit 64-bit integers.
    """
    n, dims = x.shape
    kind = _score_type(q, x)
    lists = np.sort(x, axis=0).astype(kind)  # each dimension's list, ascending
    place = np.argsort(np.argsort(x, axis=0, kind="stable"), axis=0)
    # the first half of the columns are the lists read from the top, for weights above 0, the second those read from the bottom
    place = np.concatenate([n - 1 - place, place], axis=1)
    both = np.concatenate([x, x], axis=1).astype(kind)
    weights = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1).astype(kind)
    worst = np.concatenate([lists[:1], lists[-1:]], axis=1) if n else np.zeros((1, 2 * dims), kind)
    own = cid[None, :] == qid[:, None]
    least = np.array(-np.inf if kind is not np.int64 else np.iinfo(np.int64).min, kind)
    lower = np.where(own, least, weights @ worst.T)
    reading, alive, depth, done = np.arange(len(q)), ~own, np.ones(len(q)), 0
    while done < n and len(reading):
        stretch = max((n - done) // 2, 1) if n - done > k else n - done  # half of what is left, to the end
        read = (place >= done) & (place < done + stretch)
        done += stretch
        lower += weights @ np.where(read, both - worst, np.array(0, kind)).T
        if n <= k:
            continue
        stand = np.concatenate([lists[n - done : n - done + 1], lists[done - 1 : done]], axis=1)
        upper = lower + weights @ np.where(place >= done, stand - worst, np.array(0, kind)).T
        kth = np.partition(lower, n - k, axis=1)[:, n - k]
        still = upper >= kth[:, None]
        alive[reading] &= still
        stop = alive[reading].sum(axis=1) <= FINALISTS * k
        if stop.any():
            depth[reading[stop]] = done / n
            reading, lower, weights = reading[~stop], lower[~stop], weights[~stop]
    rows, cols = np.nonzero(alive)
    scores = np.empty(len(rows), dtype=np.int64)
    step = 1 << 17
    for i in range(0, len(rows), step):
        r, c = rows[i : i + step], cols[i : i + step]
        scores[i : i + step] = np.einsum("ij,ij->i", q[r], x[c])
    by = np.lexsort((cid[cols], -scores, rows))
    rows, cols, scores = rows[by], cols[by], scores[by]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep], scores[keep], depth[rows[keep]]


def _matrix(blobs: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=">i8").astype(np.int64).reshape(len(blobs), width) if len(blobs) else np.zeros((0, width), np.int64)


def top_k(queries: DataFrame, candidates: DataFrame, k: int, query_block: int = 512, candidate_block: int = 4096) -> DataFrame:
    """The k largest inner products of each query: query_id, rank, vec_id, score, depth.

    depth: the share of its lists that the query had read in the block of the
    candidate when its bounds were enough.

    queries, candidates: columns id (long), v (array of long). Ids that are null,
    vectors that are null, and elements that are null take no part; vectors of
    different lengths are not compared with each other. Repeated ids are kept as
    they stand, so a repeated candidate can hold several ranks. Empty inputs
    give an empty result.
    """
    def ready(df: DataFrame) -> DataFrame:
        df = df.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda e: e.isNull()))
        packed = F.unhex(F.array_join(F.transform("v", lambda e: F.lpad(F.hex(e), 16, "0")), ""))
        return df.select("id", F.size("v").alias("d"), packed.alias("b"))

    q, c = materialise(ready(queries), "topk-queries"), materialise(ready(candidates), "topk-candidates")
    nq, nc = q.count(), c.count()  # of Parquet tables: read off their footers
    qb, cb = max(1, math.ceil(nq / query_block)), max(1, math.ceil(nc / candidate_block))
    if nc:
        cb = max(cb, min(16, math.ceil(nc / 512)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = q.withColumn("qb", deal(qb)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cb - 1))))
    right = c.withColumn("cb", deal(cb)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "depth": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "int64", "depth": "float64"})
        width = int(a["d"].iloc[0])
        qid, cid = a["id"].to_numpy(np.int64), b["id"].to_numpy(np.int64)
        r, s, score, depth = nra_block(qid, _matrix(a["b"], width), cid, _matrix(b["b"], width), k)
        return pd.DataFrame({"query_id": qid[r], "vec_id": cid[s], "score": score, "depth": depth})

    keys = ("qb", "cb", "d")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, "query_id long, vec_id long, score long, depth double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "depth")


def scaled(df: DataFrame, id_col: str, vec_col: str, factor: int = 64) -> DataFrame:
    """id, v: floor(factor * x) of every component. Rows with a null id or vector, or a null or non-finite component, go."""
    x = lambda e: e.cast("double")
    good = F.forall(vec_col, lambda e: e.isNotNull() & ~F.isnan(x(e)) & (F.abs(x(e)) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & good).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda e: F.floor(F.lit(float(factor)) * x(e)).cast("long")).alias("v")
    )
