"""Homogeneous and boundary regions of a labelled reference set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .knn import knn_join, nearest_opposite, vote

A_LEGIT, A_FRAUD, B = 0, 1, 2


def box(f: Column, count: Column, k: int) -> Column:
    """0: legit among legit only, 1: fraud among fraud only, 2: the boundary."""
    return F.when(~f & (count == 0), A_LEGIT).when(f & (count == k), A_FRAUD).otherwise(B)


def counted(refs: DataFrame, k: int) -> DataFrame:
    """refs with c, the fraud votes of their k nearest others (0 if there are none)."""
    votes = vote(knn_join(refs, refs, k, exclude_self=True)).select(F.col("query_id").alias("id"), F.col("fraud_count").alias("c"))
    return refs.join(votes, "id", "left").withColumn("c", F.coalesce("c", F.lit(0)))


def partitioned(refs: DataFrame, k: int) -> DataFrame:
    """refs with c and box0, the box before any halo."""
    return counted(refs, k).withColumn("box0", box(F.col("f"), F.col("c"), k))


def promoted(box0: Column, opp_d2: Column, limit: int) -> Column:
    """The box with a halo: whatever is nearer than limit grid steps to the other label is boundary."""
    return F.when((box0 != B) & (opp_d2 < F.lit(limit * limit)), B).otherwise(box0)


def haloed(refs: DataFrame, k: int, limit: int) -> DataFrame:
    """refs with c, box0, opp_d2 and box."""
    made = partitioned(refs, k).join(nearest_opposite(refs), "id", "left")
    return made.withColumn("box", promoted(F.col("box0"), F.col("opp_d2"), limit))


def geometric_halo(refs: DataFrame, boxed: DataFrame, m: int) -> DataFrame:
    """ids of the boundary and of the m nearest neighbours of each of its members."""
    inner = boxed.where(F.col("box0") == B).select("id", "q", "f")
    near = knn_join(inner, refs, m, exclude_self=True).select(F.col("ref_id").alias("id"))
    return inner.select("id").unionByName(near).distinct()
