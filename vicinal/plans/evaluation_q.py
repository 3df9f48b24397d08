"""Queries on confusion counts, scores, sweeps, mismatches and latencies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import knn as K
from .boxes_q import _SUB, _halo, _subset
from .fixtures import SQL_BOXES, read

QUERIES, ORACLE = {}, {}
# Points of the sweeps.
THRESHOLDS = tuple(round(0.30 + 0.05 * i, 2) for i in range(9))
TAUS = (0.01, 0.05, 0.10, 0.15, 0.20, 0.30, 0.50, 0.70)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def _sql_conf(expect: str, got: str) -> str:
    return f"count(*) FILTER (({expect}) AND ({got})) AS tp, count(*) FILTER (NOT ({expect}) AND NOT ({got})) AS tn, count(*) FILTER (NOT ({expect}) AND ({got})) AS fp, count(*) FILTER (({expect}) AND NOT ({got})) AS fn"


def _sql_det(err: str = "0") -> str:
    e, n = f"CAST(fp + 3 * fn + 5 * {err} AS DOUBLE)", f"CAST(tp + tn + fp + fn + {err} AS DOUBLE)"
    return f"CASE WHEN {n} = 0 THEN 0e0 WHEN (fp + fn + {err}) / {n} > 0.15e0 THEN -3000e0 ELSE 1000e0 * log10(1e0 / greatest({e} / {n}, 0.001e0)) - 300e0 * log10(1e0 + {e}) END"


_P99 = "CASE WHEN p99 <= 0 THEN 0e0 WHEN p99 > 2000 THEN -3000e0 ELSE 1000e0 * log10(1000e0 / greatest(p99, 1e0)) END"
_C = f"c AS (SELECT {_sql_conf('quality = 1', 'toxic = 1')} FROM labels)"
#: Labels whose verdicts nearly always agree, so that the score is not cut off.
_CLOSE = f"k AS (SELECT {_sql_conf('quality = 1', 'CASE WHEN doc_id % 50 = 0 THEN quality = 0 ELSE quality = 1 END')} FROM labels)"


def _close(spark, d):
    good = F.col("quality") == 1
    return read(spark, d, "labels").agg(*E.confusion(good, F.when(F.col("doc_id") % 50 == 0, ~good).otherwise(good)))


def _cols():
    return [F.col(c) for c in ("tp", "tn", "fp", "fn")]


@query("confusion_binary", f"WITH {_C} SELECT * FROM c")
def confusion_binary(spark, d):
    return read(spark, d, "labels").agg(*E.confusion(F.col("quality") == 1, F.col("toxic") == 1))


@query("score_det", f"WITH {_CLOSE} SELECT *, round({_sql_det()}, 6) AS score_det FROM k UNION ALL SELECT *, round({_sql_det()}, 6) FROM (WITH {_C} SELECT * FROM c)")
def score_det(spark, d):
    return _close(spark, d).unionByName(confusion_binary(spark, d)).withColumn("score_det", F.round(E.score_det(*_cols()), 6))


_LAT = "SELECT list_sort(list(value))[CAST(least(floor(count(value) * 99e0 / 100e0) + 1, count(value)) AS INT)] AS p99 FROM events"


@query("score_p99", f"WITH l AS ({_LAT}) SELECT round(p99, 6) AS p99, round({_P99}, 6) AS score_p99 FROM l")
def score_p99(spark, d):
    made = read(spark, d, "events").agg(E.exact_percentile("value", 99).alias("p99"))
    return made.select(F.round("p99", 6).alias("p99"), F.round(E.score_p99(F.col("p99")), 6).alias("score_p99"))


@query("final_score", f"WITH l AS ({_LAT}), {_CLOSE} SELECT tp, tn, fp, fn, round({_sql_det()}, 6) AS score_det, round({_P99}, 6) AS score_p99, round({_sql_det()} + {_P99}, 6) AS final FROM k, l")
def final_score(spark, d):
    both = _close(spark, d).crossJoin(read(spark, d, "events").agg(E.exact_percentile("value", 99).alias("p99")))  # a row each
    det, p99 = E.score_det(*_cols()), E.score_p99(F.col("p99"))
    return both.select("tp", "tn", "fp", "fn", F.round(det, 6).alias("score_det"), F.round(p99, 6).alias("score_p99"), F.round(det + p99, 6).alias("final"))


def _swept(spark, rows, values, name):
    return rows.crossJoin(F.broadcast(spark.createDataFrame([(v,) for v in values], f"{name} double")))


@query("threshold_sweep", f"WITH s AS (SELECT unnest([{', '.join(f'{t}e0' for t in THRESHOLDS)}]) AS threshold), r AS (SELECT threshold, {_sql_conf('quality = 1', '(CASE WHEN quality = 1 THEN 40 ELSE 0 END + doc_id * 37 % 61) / 100e0 >= threshold')} FROM labels, s GROUP BY threshold) SELECT *, round({_sql_det()}, 6) AS score_det FROM r")
def threshold_sweep(spark, d):
    p = (F.when(F.col("quality") == 1, 40).otherwise(0) + F.col("doc_id") * 37 % 61) / F.lit(100.0)
    made = _swept(spark, read(spark, d, "labels"), THRESHOLDS, "threshold").groupBy("threshold").agg(*E.confusion(F.col("quality") == 1, p >= F.col("threshold")))
    return made.withColumn("score_det", F.round(E.score_det(*_cols()), 6))


_TAU_SQL = f"s AS (SELECT unnest([{', '.join(f'{t}e0' for t in TAUS)}]) AS tau), r AS (SELECT tau, count(*) FILTER ((doc_id * 53 % 100) / 100e0 > tau) AS slow, {_sql_conf('quality = 1', 'CASE WHEN (doc_id * 53 % 100) / 100e0 > tau THEN quality = 1 ELSE toxic = 1 END')} FROM labels, s GROUP BY tau)"


@query("tau_sweep", f"WITH {_TAU_SQL} SELECT *, round({_sql_det()}, 6) AS score_det FROM r")
def tau_sweep(spark, d):
    slow = (F.col("doc_id") * 53 % 100) / F.lit(100.0) > F.col("tau")
    good = F.col("quality") == 1
    made = _swept(spark, read(spark, d, "labels"), TAUS, "tau").groupBy("tau").agg(E.n_if(slow).alias("slow"), *E.confusion(good, F.when(slow, good).otherwise(F.col("toxic") == 1)))
    return made.withColumn("score_det", F.round(E.score_det(*_cols()), 6))


@query("best_threshold", f"WITH {_TAU_SQL}, z AS (SELECT *, {_sql_det()} AS s FROM r) SELECT tau, round(s, 6) AS score_det FROM z ORDER BY s DESC, tau LIMIT 1")
def best_threshold(spark, d):
    return tau_sweep(spark, d).orderBy(F.desc("score_det"), "tau").limit(1).select("tau", "score_det")


_GUESS = "guess AS (SELECT *, CASE WHEN q[1] > 800 THEN 1 WHEN q[1] < -200 THEN 0 ELSE 2 END AS pred FROM box0)"


def _guessed(spark, d):
    return _halo(spark, d).withColumn("pred", F.when(F.col("q")[0] > 800, 1).when(F.col("q")[0] < -200, 0).otherwise(2))


@query("confusion_3x3", f"WITH {SQL_BOXES}, {_GUESS} SELECT CAST(k.k AS INTEGER) AS truth, " + ", ".join(f"count(*) FILTER (pred = {i}) AS pred{i}" for i in range(3)) + " FROM range(3) k(k) LEFT JOIN guess ON box0 = k.k GROUP BY k.k")
def confusion_3x3(spark, d):
    made = _guessed(spark, d).groupBy(F.col("box0").alias("truth")).agg(*[E.n_if(F.col("pred") == i).alias(f"pred{i}") for i in range(3)])
    bins = spark.range(3).select(F.col("id").cast("int").alias("truth"))
    return bins.join(made, "truth", "left").na.fill(0)


@query("misroute_analysis", f"WITH {SQL_BOXES}, {_GUESS} SELECT count(*) AS n, round(avg(CASE WHEN pred = box0 THEN 1e0 ELSE 0e0 END), 6) AS accuracy, count(*) FILTER (box0 = 2 AND pred <> 2) AS misrouted, count(*) FILTER (box0 = 2 AND pred <> 2 AND (pred = 1) = (c * 5 >= 75)) AS correct_anyway, round(count(*) FILTER (box0 = 2 AND pred = 2) / CAST(count(*) FILTER (box0 = 2) AS DOUBLE), 6) AS recall_b FROM guess")
def misroute_analysis(spark, d):
    b, p = F.col("box0"), F.col("pred")
    away = (b == 2) & (p != 2)
    return _guessed(spark, d).agg(F.count("*").alias("n"), F.round(E.agreement(b, p), 6).alias("accuracy"), E.n_if(away).alias("misrouted"), E.n_if(away & ((p == 1) == (F.col("c") * 5 >= 75))).alias("correct_anyway"), F.round(E.n_if((b == 2) & (p == 2)) / E.n_if(b == 2).cast("double"), 6).alias("recall_b"))


@query("class_weights", f"WITH {SQL_BOXES}, k AS (SELECT box0, count(*) AS n FROM box0 GROUP BY box0) SELECT box0, n, round(greatest(1e0, (SELECT sum(n) FROM k) / (n * 3e0)), 6) AS weight FROM k")
def class_weights(spark, d):
    made = _halo(spark, d).groupBy("box0").agg(F.count("*").alias("n"))
    total = made.agg(F.sum("n").alias("total"))
    return made.crossJoin(F.broadcast(total)).select("box0", "n", F.round(F.greatest(F.lit(1.0), F.col("total") / (F.col("n") * 3.0)), 6).alias("weight"))


@query("split_assign", "WITH h AS (SELECT vec_id, row_number() OVER (ORDER BY (vec_id * 2654435761) % 4294967296, vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings) SELECT vec_id, CASE WHEN r * 10 < n * 8 THEN 'train' WHEN r * 10 < n * 9 THEN 'val' ELSE 'test' END AS split FROM h")
def split_assign(spark, d):
    """80 / 10 / 10 by rank of a hash. Ranks come from the hash's range, a bucket of which is one task's."""
    h = F.col("vec_id") * F.lit(2654435761) % F.lit(4294967296)
    rows = read(spark, d, "embeddings").select("vec_id", h.alias("h")).withColumn("b", F.floor(F.col("h") / (1 << 24)))
    sizes = rows.groupBy("b").count()
    before = sizes.select("b", F.coalesce(F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("count").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    ranked = rows.join(F.broadcast(before), "b").withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("h", "vec_id")) - 1 + F.col("before"))
    return ranked.select("vec_id", F.when(F.col("r") * 10 < F.col("n") * 8, "train").when(F.col("r") * 10 < F.col("n") * 9, "val").otherwise("test").alias("split"))


@query("mismatches", f"{_SUB} SELECT vec_id, c_full < 3 AS expected_approved, c_sub < 3 AS actual_approved, c_sub / 5e0 AS actual_fraud_score FROM v WHERE (c_full < 3) <> (c_sub < 3)")
def mismatches(spark, d):
    a, b = F.col("c_full") < 3, F.col("c_sub") < 3
    return _subset(spark, d).where(a != b).select("vec_id", a.alias("expected_approved"), b.alias("actual_approved"), (F.col("c_sub") / 5.0).alias("actual_fraud_score"))


#: Replayed answers over labels: every 41st request fails, every 50th verdict is turned.
_REPLAY = "rp AS (SELECT doc_id, quality = 1 AS expected, CASE WHEN doc_id % 41 = 0 THEN NULL WHEN doc_id % 50 = 0 THEN quality <> 1 ELSE quality = 1 END AS actual FROM labels)"


def _replayed(spark, d):
    good = F.col("quality") == 1
    return read(spark, d, "labels").select("doc_id", good.alias("expected"), F.when(F.col("doc_id") % 41 != 0, F.when(F.col("doc_id") % 50 == 0, ~good).otherwise(good)).alias("actual"))


@query("replay_mismatches", f"WITH {_REPLAY} SELECT doc_id, expected, actual, CASE WHEN actual IS NULL THEN 'error' WHEN expected THEN 'fp' ELSE 'fn' END AS kind FROM rp WHERE actual IS NULL OR expected <> actual")
def replay_mismatches(spark, d):
    """Requests that failed, or whose verdict isn't the expected one; actual is null for those that failed."""
    e, a = F.col("expected"), F.col("actual")
    return _replayed(spark, d).where(a.isNull() | (e != a)).withColumn("kind", F.when(a.isNull(), "error").when(e, "fp").otherwise("fn"))


@query("mismatch_summary", f"WITH {_REPLAY} SELECT count(*) AS n, count(*) FILTER (expected AND NOT actual) AS fp, count(*) FILTER (NOT expected AND actual) AS fn, count(*) FILTER (actual IS NULL) AS errors FROM rp")
def mismatch_summary(spark, d):
    e, a = F.col("expected"), F.col("actual")
    return _replayed(spark, d).agg(F.count("*").alias("n"), E.n_if(e & ~a).alias("fp"), E.n_if(~e & a).alias("fn"), E.n_if(a.isNull()).alias("errors"))


@query("mismatch_diagnosis", f"{_SUB}, m AS (SELECT * FROM v WHERE c_full <> c_sub), o AS (SELECT n1.qid, count(n2.rid) AS overlap, count(*) FILTER (h.box <> 2) AS outside FROM n1 LEFT JOIN n2 ON n1.qid = n2.qid AND n1.rid = n2.rid JOIN halo h ON h.id = n1.rid GROUP BY n1.qid) SELECT m.vec_id, m.c_full, m.c_sub, o.overlap, o.outside FROM m JOIN o ON o.qid = m.vec_id")
def mismatch_diagnosis(spark, d):
    h = _halo(spark, d)
    b = h.where("box = 2").select("id", "q", "f")
    full, sub = K.knn_join(b, h.select("id", "q", "f"), 5, exclude_self=True), K.knn_join(b, b, 5, exclude_self=True)
    where = full.join(h.select(F.col("id").alias("ref_id"), "box"), "ref_id").join(sub.select("query_id", "ref_id", F.lit(1).alias("hit")), ["query_id", "ref_id"], "left")
    about = where.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("hit").alias("overlap"), E.n_if(F.col("box") != 2).alias("outside"))
    return _subset(spark, d).where("c_full <> c_sub").join(about, "vec_id")


def _sql_pct(p: float) -> str:
    return f"list_sort(list(value))[CAST(least(floor(count(value) * {p}e0 / 100e0) + 1, count(value)) AS INT)]"


def latency_buckets(events, unit: str, percentile):
    """bucket_s, max_ms, p99_ms, n by whole seconds or days; works on streams too."""
    return events.groupBy(F.window("ts", f"1 {unit}").start.alias("start")).agg(F.max("value").alias("max_ms"), percentile.alias("p99_ms"), F.count("*").alias("n"))


def _latency(spark, d, unit):
    made = latency_buckets(read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value"), unit, F.percentile("value", 0.99))
    return made.select(F.unix_timestamp("start").alias("bucket_s"), F.round("max_ms", 3).alias("max_ms"), F.round("p99_ms", 3).alias("p99_ms"), "n")


def _sql_latency(seconds: int) -> str:
    return f"SELECT CAST(epoch(ts) AS BIGINT) // {seconds} * {seconds} AS bucket_s, round(max(value), 3) AS max_ms, round(quantile_cont(value, 0.99), 3) AS p99_ms, count(*) AS n FROM (SELECT date_trunc('second', ts) AS ts, value FROM events) GROUP BY 1"


@query("second_series", "WITH s AS (SELECT CAST(floor(epoch(ts - INTERVAL 0 SECOND) - epoch(m)) AS INTEGER) // 86400 AS t_sec, value FROM events, (SELECT date_trunc('day', min(ts)) AS m FROM events)) SELECT t_sec, max(value) AS max_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, count(*) AS n FROM s WHERE t_sec >= 0 AND t_sec < 200 GROUP BY t_sec")
def second_series(spark, d):
    """The series of a run in which a day of events counts as a second: what lies past 200 is dropped."""
    from ..streaming.scoring import second_series as series

    events = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    began = events.agg(F.unix_timestamp(F.date_trunc("day", F.min("ts"))).alias("m"))
    day = events.crossJoin(F.broadcast(began)).select(F.timestamp_seconds((F.col("ts").cast("double") - F.col("m")) / 86400).alias("ts"), "value")
    return series(day, "1970-01-01 00:00:00").withColumn("p99_ms", F.round("p99_ms", 6))


@query("latency_per_second", _sql_latency(1))
def latency_per_second(spark, d):
    return _latency(spark, d, "second")


@query("latency_per_day", _sql_latency(86400))
def latency_per_day(spark, d):
    return _latency(spark, d, "day")


@query("latency_percentiles", "SELECT event_type, " + ", ".join(f"round({_sql_pct(p)}, 6) AS p{p}" for p in (50, 90, 95, 99)) + " FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(*[F.round(E.exact_percentile("value", p), 6).alias(f"p{p}") for p in (50, 90, 95, 99)])


_TREND = (("med", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))


@query("trend_stats", "SELECT round(min(value), 6) AS min, round(avg(value), 6) AS avg, round(max(value), 6) AS max, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS {n}" for n, p in _TREND) + " FROM events")
def trend_stats(spark, d):
    return read(spark, d, "events").agg(F.round(F.min("value"), 6).alias("min"), F.round(F.avg("value"), 6).alias("avg"), F.round(F.max("value"), 6).alias("max"), *[F.round(F.percentile("value", p), 6).alias(n) for n, p in _TREND])


@query("metric_tsv", "SELECT event_type || chr(9) || CAST(count(*) AS VARCHAR) || chr(9) || printf('%.3f', max(value)) AS line FROM events GROUP BY event_type")
def metric_tsv(spark, d):
    made = read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("m"))
    return made.select(F.concat_ws("\t", "event_type", F.col("n").cast("string"), F.format_string("%.3f", "m")).alias("line"))
