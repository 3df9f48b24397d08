"""The scoring chain: body, features, router, and a search for what the router leaves open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features
from . import ivf, knn


def routed(bodies: DataFrame, router, tau: float = 0.5) -> DataFrame:
    """key, malformed, q, p (the router's probabilities of legit, fraud and boundary), slow, of bodies (key, body)."""
    made = features.vectorise(features.parse(bodies))
    vec = F.when(F.col("malformed"), F.array(*[F.lit(0.0)] * 14)).otherwise(F.col("vec"))
    made = made.withColumn("p", router(vec))
    return made.select("key", "malformed", "q", "p", (~F.col("malformed") & (F.col("p")[2] > tau)).alias("slow"))


def verdicts(made: DataFrame, postings: DataFrame, centroids: DataFrame, k: int = 5, nprobe: int = 16, pieces: list | None = None) -> DataFrame:
    """key, malformed, slow, fraud_count, approved, fraud_score of every row of what `routed` made.

    Malformed bodies are approved with a count of 0. The index is only searched
    for rows that the router takes for boundary. It goes to the rows, of which
    none moves, whole or in pieces (those of `ivf.pieces`, if they are at hand).
    """
    fast = F.when(F.col("p")[0] > F.col("p")[1], 0).otherwise(k)
    count = F.when(F.col("malformed"), 0).when(F.col("slow"), F.coalesce("votes", F.lit(0))).otherwise(fast).cast("int")
    index = ivf.pieces(postings, centroids) if pieces is None else pieces
    both = made.withColumn("votes", ivf.votes(index, k, nprobe)(F.when(F.col("slow"), F.col("q"))))
    return knn.verdict(both.select("key", "malformed", "slow", count.alias("fraud_count")), k)
