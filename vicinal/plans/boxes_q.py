"""Queries on boxes, halos and subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes as X
from ..operators import evaluate as E
from ..operators import knn as K
from ..sources.tables import once
from .fixtures import BOX_K, HALO, SQL_BOXES, SQL_REFS4, haloed4, refs4, sql_d2, sql_nn

QUERIES, ORACLE = {}, {}

# Halos of the sweeps, in grid steps.
SWEEP = (1000, 1500, 2000, 3000, 5000, 10000)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def _halo(spark, d):
    return haloed4(spark, d)


def _pct(n, total):
    return F.round(F.lit(100.0) * n / total, 4)


@query("count_distribution", f"WITH {SQL_BOXES} SELECT CAST(k.k AS INTEGER) AS fraud_count, count(b.id) AS n, round(100e0 * count(b.id) / (SELECT count(*) FROM box0), 4) AS pct FROM range(0, {BOX_K + 1}) k(k) LEFT JOIN box0 b ON b.c = k.k GROUP BY k.k")
def count_distribution(spark, d):
    c = X.counted(refs4(spark, d), BOX_K).groupBy(F.col("c").alias("fraud_count")).count()
    bins = spark.range(BOX_K + 1).select(F.col("id").cast("int").alias("fraud_count"))
    made = bins.join(c, "fraud_count", "left").select("fraud_count", F.coalesce("count", F.lit(0)).alias("n"))
    total = made.agg(F.sum("n").alias("total"))
    return made.crossJoin(F.broadcast(total)).select("fraud_count", "n", _pct(F.col("n"), F.col("total")).alias("pct"))


@query("purity_summary", f"WITH {SQL_BOXES} SELECT count(*) AS n, count(*) FILTER (c = 0 OR c = {BOX_K}) AS pure, count(*) FILTER (c > 0 AND c < {BOX_K}) AS mixed, count(*) FILTER (c * 5 >= 3 * {BOX_K}) AS denied, round(100e0 * count(*) FILTER (c = 0 OR c = {BOX_K}) / count(*), 4) AS pure_pct, round(avg(CASE WHEN f THEN 1e0 ELSE 0e0 END), 6) AS fraud_rate FROM box0")
def purity_summary(spark, d):
    c = X.counted(refs4(spark, d), BOX_K)
    pure = (F.col("c") == 0) | (F.col("c") == BOX_K)
    return c.agg(F.count("*").alias("n"), E.n_if(pure).alias("pure"), E.n_if(~pure).alias("mixed"), E.n_if(F.col("c") * 5 >= 3 * BOX_K).alias("denied"), _pct(E.n_if(pure), F.count("*")).alias("pure_pct"), F.round(F.avg(F.col("f").cast("double")), 6).alias("fraud_rate"))


@query("partition_boxes", f"WITH {SQL_BOXES} SELECT id AS vec_id, c AS fraud_count, box0 FROM box0")
def partition_boxes(spark, d):
    return X.partitioned(refs4(spark, d), BOX_K).select(F.col("id").alias("vec_id"), F.col("c").alias("fraud_count"), "box0")


@query("box_b_subset", f"WITH {SQL_BOXES} SELECT id AS vec_id, q, f AS is_fraud FROM box0 WHERE box0 = 2")
def box_b_subset(spark, d):
    return X.partitioned(refs4(spark, d), BOX_K).where("box0 = 2").select(F.col("id").alias("vec_id"), "q", F.col("f").alias("is_fraud"))


@query("nearest_opp", f"WITH {SQL_REFS4} SELECT a.id AS vec_id, min({sql_d2('a.q', 'b.q')}) AS opp_d2 FROM refs a JOIN refs b ON a.f <> b.f GROUP BY a.id")
def nearest_opp(spark, d):
    return K.nearest_opposite(refs4(spark, d)).withColumnRenamed("id", "vec_id")


@query("border_halo", f"WITH {SQL_BOXES} SELECT id AS vec_id, box0, opp_d2, box FROM halo")
def border_halo(spark, d):
    return X.haloed(refs4(spark, d), BOX_K, HALO).select(F.col("id").alias("vec_id"), "box0", "opp_d2", "box")


@query("halo_report", f"WITH {SQL_BOXES} SELECT count(*) AS n, count(*) FILTER (box0 = 2) AS b_before, count(*) FILTER (box = 2) AS b_after, count(*) FILTER (box0 = 0 AND box = 2) AS from_legit, count(*) FILTER (box0 = 1 AND box = 2) AS from_fraud FROM halo")
def halo_report(spark, d):
    b0, b = F.col("box0"), F.col("box")
    return _halo(spark, d).agg(F.count("*").alias("n"), E.n_if(b0 == 2).alias("b_before"), E.n_if(b == 2).alias("b_after"), E.n_if((b0 == 0) & (b == 2)).alias("from_legit"), E.n_if((b0 == 1) & (b == 2)).alias("from_fraud"))


_SWEEP_SQL = "s AS (SELECT CAST(unnest([" + ", ".join(map(str, SWEEP)) + "]) AS INTEGER) AS limit_steps)"


@query("halo_sweep", f"WITH {SQL_BOXES}, {_SWEEP_SQL} SELECT limit_steps, count(*) FILTER (box0 = 2 OR opp_d2 < CAST(limit_steps AS BIGINT) * limit_steps) AS b_size, count(*) FILTER (box0 <> 2 AND opp_d2 < CAST(limit_steps AS BIGINT) * limit_steps) AS promoted, count(*) FILTER (id % 37 = 0 AND (box0 = 2 OR opp_d2 < CAST(limit_steps AS BIGINT) * limit_steps)) AS recovered FROM halo CROSS JOIN s GROUP BY limit_steps")
def halo_sweep(spark, d):
    sweep = spark.createDataFrame([(s,) for s in SWEEP], "limit_steps int")
    near = F.col("opp_d2") < F.col("limit_steps").cast("long") * F.col("limit_steps")
    inside = (F.col("box0") == 2) | F.coalesce(near, F.lit(False))
    return _halo(spark, d).crossJoin(F.broadcast(sweep)).groupBy("limit_steps").agg(E.n_if(inside).alias("b_size"), E.n_if((F.col("box0") != 2) & near).alias("promoted"), E.n_if((F.col("id") % 37 == 0) & inside).alias("recovered"))


@query("geometric_halo", f"WITH {SQL_BOXES}, b AS (SELECT * FROM box0 WHERE box0 = 2), {sql_nn('near', 'b', 'refs', 5)} SELECT id AS vec_id FROM b UNION SELECT rid FROM near")
def geometric_halo(spark, d):
    return X.geometric_halo(refs4(spark, d), _halo(spark, d), 5).select(F.col("id").alias("vec_id"))


@query("halo_simulation", f"WITH {SQL_BOXES}, {_SWEEP_SQL}, {sql_nn('full5', 'refs', 'refs', 5)}, truth AS (SELECT qid, sum(CAST(rf AS INT)) AS c FROM full5 GROUP BY qid), cand AS (SELECT s.limit_steps, a.id AS qid, b.id AS rid, b.f AS rf, {sql_d2('a.q', 'b.q')} AS d2 FROM s, refs a, halo b WHERE a.id <> b.id AND (b.box0 = 2 OR b.opp_d2 < CAST(s.limit_steps AS BIGINT) * s.limit_steps)), top AS (SELECT limit_steps, qid, sum(CAST(rf AS INT)) AS c FROM (SELECT *, row_number() OVER (PARTITION BY limit_steps, qid ORDER BY d2, rid) AS rk FROM cand) WHERE rk <= 5 GROUP BY limit_steps, qid) SELECT t.limit_steps, count(*) FILTER (u.c >= 3 AND t.c >= 3) AS tp, count(*) FILTER (u.c < 3 AND t.c < 3) AS tn, count(*) FILTER (u.c < 3 AND t.c >= 3) AS fp, count(*) FILTER (u.c >= 3 AND t.c < 3) AS fn FROM top t JOIN truth u USING (qid) GROUP BY t.limit_steps")
def halo_simulation(spark, d):
    """Verdicts of every reference from the rows within each halo of the sweep, against those from all rows."""
    h, r = _halo(spark, d), refs4(spark, d)
    truth = once(spark, f"{d}/truth4", lambda: K.vote(K.knn_join(r, r, 5, exclude_self=True)).select("query_id", F.col("fraud_count").alias("u")))
    made = None
    for limit in SWEEP:  # a handful of parameters
        inside = h.where((F.col("box0") == 2) | (F.col("opp_d2") < limit * limit)).select("id", "q", "f")
        got = K.vote(K.knn_join(r, inside, 5, exclude_self=True)).select("query_id", "fraud_count").withColumn("limit_steps", F.lit(limit))
        made = got if made is None else made.unionByName(got)
    return made.join(truth, "query_id").groupBy("limit_steps").agg(*E.confusion(F.col("u") >= 3, F.col("fraud_count") >= 3))


_SUB = f"WITH {SQL_BOXES}, b AS (SELECT id, q, f FROM halo WHERE box = 2), {sql_nn('n1', 'b', 'refs', 5)}, {sql_nn('n2', 'b', 'b', 5)}, v AS (SELECT x.qid AS vec_id, x.c AS c_full, coalesce(y.c, 0) AS c_sub FROM (SELECT qid, CAST(sum(CAST(rf AS INT)) AS INT) AS c FROM n1 GROUP BY qid) x LEFT JOIN (SELECT qid, CAST(sum(CAST(rf AS INT)) AS INT) AS c FROM n2 GROUP BY qid) y USING (qid))"


def _subset(spark, d):
    b = _halo(spark, d).where("box = 2").select("id", "q", "f")
    full = K.vote(K.knn_join(b, refs4(spark, d), 5, exclude_self=True)).select("query_id", F.col("fraud_count").alias("c_full"))
    sub = K.vote(K.knn_join(b, b, 5, exclude_self=True)).select("query_id", F.col("fraud_count").alias("c_sub"))
    return full.join(sub, "query_id", "left").select(F.col("query_id").alias("vec_id"), "c_full", F.coalesce("c_sub", F.lit(0)).alias("c_sub"))


@query("validate_subset", f"{_SUB} SELECT vec_id, c_full, c_sub FROM v")
def validate_subset(spark, d):
    return _subset(spark, d)


@query("confusion_6x6", f"{_SUB} SELECT c_full, " + ", ".join(f"count(*) FILTER (c_sub = {i}) AS s{i}" for i in range(6)) + " FROM v GROUP BY c_full")
def confusion_6x6(spark, d):
    return _subset(spark, d).groupBy("c_full").agg(*[E.n_if(F.col("c_sub") == i).alias(f"s{i}") for i in range(6)])


@query("agreement", f"{_SUB} SELECT count(*) AS n, round(avg(CASE WHEN c_full = c_sub THEN 1e0 ELSE 0e0 END), 6) AS exact, round(avg(CASE WHEN (c_full >= 3) = (c_sub >= 3) THEN 1e0 ELSE 0e0 END), 6) AS binary_agreement FROM v")
def agreement(spark, d):
    a, b = F.col("c_full"), F.col("c_sub")
    return _subset(spark, d).agg(F.count("*").alias("n"), F.round(E.agreement(a, b), 6).alias("exact"), F.round(E.agreement(a >= 3, b >= 3), 6).alias("binary_agreement"))


@query("agreement_by_count", f"{_SUB} SELECT c_full, count(*) AS n, count(*) FILTER (c_full = c_sub) AS same, round(avg(CASE WHEN (c_full >= 3) = (c_sub >= 3) THEN 1e0 ELSE 0e0 END), 6) AS binary_agreement FROM v GROUP BY c_full")
def agreement_by_count(spark, d):
    a, b = F.col("c_full"), F.col("c_sub")
    return _subset(spark, d).groupBy("c_full").agg(F.count("*").alias("n"), E.n_if(a == b).alias("same"), F.round(E.agreement(a >= 3, b >= 3), 6).alias("binary_agreement"))


TAUS = (-900, -300, 0, 300, 900)  # cut-offs of the first component, in grid steps, in the place of a router's


@query("validate_by_tau", f"{_SUB}, t AS (SELECT CAST(unnest([{', '.join(map(str, TAUS))}]) AS INTEGER) AS tau) SELECT tau, count(*) AS n, round(avg(CASE WHEN c_full = c_sub THEN 1e0 ELSE 0e0 END), 6) AS exact, round(avg(CASE WHEN (c_full >= 3) = (c_sub >= 3) THEN 1e0 ELSE 0e0 END), 6) AS binary_agreement FROM v JOIN refs r ON r.id = v.vec_id JOIN t ON r.q[1] > t.tau GROUP BY tau")
def validate_by_tau(spark, d):
    """The subset's verdicts against those of all, over what each cut-off sends to the search."""
    cuts = spark.createDataFrame([(t,) for t in TAUS], "tau int")
    rows = _subset(spark, d).join(refs4(spark, d).select(F.col("id").alias("vec_id"), F.col("q")[0].alias("x")), "vec_id").join(F.broadcast(cuts), F.col("x") > F.col("tau"))
    a, b = F.col("c_full"), F.col("c_sub")
    return rows.groupBy("tau").agg(F.count("*").alias("n"), F.round(E.agreement(a, b), 6).alias("exact"), F.round(E.agreement(a >= 3, b >= 3), 6).alias("binary_agreement"))


@query("subset_megabytes", f"WITH {SQL_BOXES} SELECT box, count(*) AS n, round(count(*) * 56 / 1e6, 6) AS mb FROM halo GROUP BY box")
def subset_megabytes(spark, d):
    from ..functions.vectors import megabytes

    return _halo(spark, d).groupBy("box").agg(F.count("*").alias("n"), F.round(megabytes(F.count("*")), 6).alias("mb"))
