"""Online scoring and latency series as Structured Streaming queries.

The transforms are those of the batch queries; a stream only changes what is
read and written. Scoring keeps no state: the index is a static table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cascade, ivf


def routed_verdicts(bodies: DataFrame, postings: DataFrame, centroids: DataFrame, router, tau: float = 0.5, k: int = 5, nprobe: int = 16) -> DataFrame:
    """key, fraud_count, approved, fraud_score of a batch of bodies (key long, body string).

    router: a function from vectors to probabilities of legit, fraud and
    boundary. Malformed bodies are approved with a count of 0.
    """
    return cascade.verdicts(cascade.routed(bodies, router, tau), postings, centroids, k, nprobe).select("key", "fraud_count", "approved", "fraud_score")


def start_scoring(stream: DataFrame, path: str, checkpoint: str, postings: DataFrame, centroids: DataFrame, router, tau: float = 0.5, k: int = 5, nprobe: int = 16) -> StreamingQuery:
    """Scores each micro-batch and appends its verdicts to path; a batch that is replayed replaces its own output.

    A batch is read, parsed and routed once: what the router made is kept until
    the verdicts are written.
    """

    index = ivf.pieces(postings, centroids)

    def write(batch: DataFrame, number: int) -> None:
        made = cascade.routed(batch, router, tau).persist()
        try:
            cascade.verdicts(made, postings, centroids, k, nprobe, index).select("key", "fraud_count", "approved", "fraud_score").write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            made.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Seconds after the start of a run of which a series tells.
HORIZON = 200


def second_series(samples: DataFrame, start: str, horizon: int = HORIZON) -> DataFrame:
    """t_sec, max_ms, p99_ms, n of the seconds since start (a time) that have samples; those outside [0, horizon) are dropped."""
    t = F.floor(F.col("ts").cast("timestamp").cast("double") - F.to_timestamp(F.lit(start)).cast("double"))
    kept = samples.withColumn("t_sec", t.cast("int")).where((F.col("t_sec") >= 0) & (F.col("t_sec") < horizon))
    return kept.groupBy("t_sec").agg(F.max("value").alias("max_ms"), F.percentile("value", 0.99).alias("p99_ms"), F.count("*").alias("n"))


def latency_series(samples: DataFrame, unit: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """start, max_ms, p99_ms, n of tumbling windows over samples (ts timestamp, value double); batch or stream."""
    windowed = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return windowed.groupBy(F.window("ts", unit).alias("w")).agg(F.max("value").alias("max_ms"), F.percentile("value", 0.99).alias("p99_ms"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "max_ms", "p99_ms", "n")


def running_confusion(verdicts: DataFrame) -> DataFrame:
    """outcome, n: running counts of tp, tn, fp, fn and error over verdicts (expected_approved, approved)."""
    expect, got = F.col("expected_approved"), F.col("approved")
    outcome = F.when(got.isNull(), "error").when(expect & got, "tn").when(expect & ~got, "fp").when(~expect & got, "fn").otherwise("tp")
    return verdicts.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def arrivals(spark, rows_per_second: int = 900, ramp_seconds: int = 120) -> DataFrame:
    """A rate source that ramps up to so many rows a second."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).option("rampUpTime", f"{ramp_seconds}s").load()
