"""Evaluation: confusion counts, scores, agreement and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of errors and cut-offs of the scores.
W_FP, W_FN, W_ERR, WORST_RATE, WORST_SCORE, LEAST_EPS = 1, 3, 5, 0.15, -3000.0, 0.001


def n_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def confusion(deny_expected: Column, deny: Column) -> list[Column]:
    """tp, tn, fp, fn; positive is a denied fraud."""
    return [n_if(deny_expected & deny).alias("tp"), n_if(~deny_expected & ~deny).alias("tn"), n_if(~deny_expected & deny).alias("fp"), n_if(deny_expected & ~deny).alias("fn")]


def score_det(tp: Column, tn: Column, fp: Column, fn: Column, err: Column | None = None) -> Column:
    """The detection score: errors weighted, on a logarithmic scale."""
    err = F.lit(0) if err is None else err
    e = (W_FP * fp + W_FN * fn + W_ERR * err).cast("double")
    n = (tp + tn + fp + fn + err).cast("double")
    some = F.when(n > 0, n)
    good = F.lit(1000.0) * F.log10(F.lit(1.0) / F.greatest(e / some, F.lit(LEAST_EPS))) - F.lit(300.0) * F.log10(F.lit(1.0) + e)
    return F.when(n == 0, 0.0).when((fp + fn + err) / some > WORST_RATE, WORST_SCORE).otherwise(good)


def score_p99(p99_ms: Column) -> Column:
    return F.when(p99_ms <= 0, 0.0).when(p99_ms > 2000, WORST_SCORE).otherwise(F.lit(1000.0) * F.log10(F.lit(1000.0) / F.greatest(p99_ms, F.lit(1.0))))


def exact_percentile(x: str, percent: float) -> Column:
    """The element at floor(n * percent / 100) of the sorted values, from 0; the last one at most.

    Tasks count equal values first and merge the counts; the share is a hair above
    percent, since the first value to reach it is taken.
    """
    return F.expr(f"percentile_disc({min(percent / 100.0 + 1e-12, 1.0)!r}D) WITHIN GROUP (ORDER BY {x})")


def agreement(a: Column, b: Column) -> Column:
    return F.avg((a == b).cast("double"))


def marginal_gain(curve: DataFrame, size: str, value: str) -> DataFrame:
    """curve with gain_pp and gain_per_1k: what each point gains over the one before."""
    w = Window.orderBy(size)
    step = F.col(value) - F.lag(value).over(w)
    return curve.withColumn("gain_pp", F.round(100 * step, 6)).withColumn("gain_per_1k", F.round(100000 * step / (F.col(size) - F.lag(size).over(w)), 6))


def usage(neighbours: DataFrame, high: int = 10, low: int = 1) -> DataFrame:
    """ref_id, score: weighted appearances; queries whose votes are 2 or 3 weigh high."""
    votes = neighbours.groupBy("query_id").agg(F.sum(F.col("ref_fraud").cast("int")).alias("c"))
    return neighbours.join(votes, "query_id").groupBy("ref_id").agg(F.sum(F.when(F.col("c").isin(2, 3), high).otherwise(low)).alias("score"))


def ranked(rows: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """rows with rank inside their group: by descending score, then ascending key.

    The rows before a score's first are summed over a table of scores; rows are
    ranked among those of one score alone, so that no task sorts a whole group.
    """
    sizes = rows.groupBy(group, score).agg(F.count("*").alias("_n"))
    above = Window.partitionBy(group).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(group, score, F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_before"))
    own = Window.partitionBy(group, score).orderBy(key)
    return rows.join(before, [group, score]).withColumn("rank", (F.row_number().over(own) + F.col("_before")).cast("int")).drop("_before")
