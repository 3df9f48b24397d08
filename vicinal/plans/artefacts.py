"""The offline chain: counts, boxes, halo and index, each step made once and kept as Parquet."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.neural import train_binary
from ..functions.vectors import SCALE
from ..operators import boxes, evaluate, ivf
from ..sources.tables import Settings, materialise_once


def build(spark: SparkSession, refs: DataFrame, path: str, settings: Settings, force: bool = False) -> dict[str, DataFrame]:
    """Tables boxes (id, q, f, c, box0, opp_d2, box), centroids, postings and offsets under path.

    refs: id, q, f. Steps whose output is there, and is newer than what it is made
    of, are not done again.
    """
    limit = round(settings.halo * 10000)
    at = lambda name: f"{path}/{name}"
    boxed = materialise_once(spark, at("boxes"), lambda: boxes.haloed(refs, settings.box_k, limit), force)
    core = boxed.where(boxed.box == boxes.B).select("id", "q", "f")
    cents = materialise_once(spark, at("centroids"), lambda: ivf.kmeans(core, settings.nlist, settings.rounds, seed=settings.seed), force, (at("boxes"),))
    posts = materialise_once(spark, at("postings"), lambda: ivf.assign(core, cents).drop("d2").repartition("cluster_id").sortWithinPartitions("cluster_id", "id"), force, (at("boxes"), at("centroids")))
    made = {"boxes": boxed, "centroids": cents, "postings": posts}
    made["offsets"] = materialise_once(spark, at("offsets"), lambda: ivf.offsets(posts, cents), force, (at("postings"),))
    return made


def feasibility(refs: DataFrame, k: int = 5, rows: int = 20000, epochs: int = 12) -> DataFrame:
    """threshold, tp, tn, fp, fn, score_det: prepare, label, train and evaluate in one chain.

    refs: id, q, f. Each reference is labelled by the vote of its k nearest others,
    a network learns the vote from at most `rows` of those with the smallest hashes,
    and its verdicts on all others are held against the vote by threshold.
    """
    labelled = boxes.counted(refs, k).withColumn("deny", F.col("c") * 5 >= 3 * k).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(10)))
    sample = labelled.where("h < 8").orderBy(F.xxhash64("id"), "id").limit(rows).select("q", "deny").collect()
    x, y = np.array([r.q for r in sample], float) / SCALE, np.array([r.deny for r in sample], int)
    net = train_binary(x, y, epochs=epochs)
    scored = labelled.where("h >= 8").withColumn("p", net.udf()(F.transform("q", lambda v: v / F.lit(float(SCALE))))[0])
    cuts = refs.sparkSession.createDataFrame([(round(0.30 + 0.05 * i, 2),) for i in range(9)], "threshold double")
    made = scored.crossJoin(F.broadcast(cuts)).groupBy("threshold").agg(*evaluate.confusion(F.col("deny"), F.col("p") >= F.col("threshold")))
    return made.withColumn("score_det", F.round(evaluate.score_det(*[F.col(c) for c in ("tp", "tn", "fp", "fn")]), 6))
