"""Queries on vectors and exact nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import knn as K
from .fixtures import SQL_REFS64, read, refs64, sql_d2, sql_nn

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def _halves(spark, d):
    r = refs64(spark, d)
    return r.where("id % 2 = 0"), r.where("id % 2 = 1")


LOO = f"WITH {SQL_REFS64}, {sql_nn('nn', 'refs', 'refs', 5)}, v AS (SELECT qid, CAST(sum(CAST(rf AS INT)) AS INT) AS c, max(d2) AS kth FROM nn GROUP BY qid)"
HALVES = f"WITH {SQL_REFS64}, qs AS (SELECT * FROM refs WHERE id % 2 = 0), rs AS (SELECT * FROM refs WHERE id % 2 = 1), {sql_nn('nn', 'qs', 'rs', 5, 'true')}"


@query("quantize_vec", f"WITH {SQL_REFS64} SELECT id AS vec_id, q FROM refs")
def quantize_vec(spark, d):
    return refs64(spark, d).select(F.col("id").alias("vec_id"), "q")


@query("quantize_vec_even", "SELECT vec_id, list_transform(embedding, lambda e: CAST(round_even(CAST(e AS DOUBLE) * 10000e0, 0) AS BIGINT)) AS q FROM embeddings")
def quantize_vec_even(spark, d):
    return read(spark, d, "embeddings").select("vec_id", V.quantise_even(F.col("embedding")).alias("q"))


@query("vector_norms", f"WITH {SQL_REFS64} SELECT id AS vec_id, CAST(list_sum(list_transform(q, lambda x: x * x)) AS BIGINT) AS norm2 FROM refs")
def vector_norms(spark, d):
    return refs64(spark, d).select(F.col("id").alias("vec_id"), V.norm_squared(F.col("q")).alias("norm2"))


PAIRS = f"WITH {SQL_REFS64} SELECT a.id AS a_id, b.id AS b_id, {sql_d2('a.q', 'b.q')} AS d2 FROM refs a JOIN refs b ON a.id % 50 = 0 AND b.id <> a.id"


def _pairs(spark, d, distance):
    r = refs64(spark, d)
    a, b = r.where("id % 50 = 0").alias("a"), r.alias("b")
    return a.join(b, F.col("a.id") != F.col("b.id")).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), distance(F.col("a.q"), F.col("b.q")).alias("d2"))


@query("l2_pairwise", PAIRS)
def l2_pairwise(spark, d):
    return _pairs(spark, d, V.l2_squared)


@query("l2_expansion", PAIRS)
def l2_expansion(spark, d):
    return _pairs(spark, d, V.l2_squared_by_norms)


@query("l2_euclidean", f"WITH p AS ({PAIRS}) SELECT a_id, b_id, round(sqrt(CAST(greatest(d2, 0) AS DOUBLE)) / 10000e0, 6) AS dist FROM p")
def l2_euclidean(spark, d):
    return _pairs(spark, d, V.l2_squared).select("a_id", "b_id", F.round(V.euclidean(F.col("d2")), 6).alias("dist"))


@query("round4", "SELECT vec_id, list_transform(embedding, lambda e: CASE WHEN e < 0 THEN -1e0 WHEN e > 0 THEN 1e0 ELSE 0e0 END * floor(abs(CAST(e AS DOUBLE)) * 10000e0 + 0.5e0) / 10000e0) AS r FROM embeddings")
def round4(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda e: V.round_half_away(e.cast("double"))).alias("r"))


@query("knn_loo_count", f"{LOO} SELECT qid AS vec_id, c AS fraud_count, kth AS kth_d2, c < 3 AS approved, c / 5e0 AS fraud_score FROM v")
def knn_loo_count(spark, d):
    r = refs64(spark, d)
    return K.verdict(K.vote(K.knn_join(r, r, 5, exclude_self=True))).withColumnRenamed("query_id", "vec_id")


@query("knn_loo_neighbors", f"{LOO} SELECT qid AS vec_id, CAST(rk AS INTEGER) AS rank, rid AS ref_id, d2 FROM nn")
def knn_loo_neighbors(spark, d):
    r = refs64(spark, d)
    return K.knn_join(r, r, 5, exclude_self=True).select(F.col("query_id").alias("vec_id"), "rank", "ref_id", "d2")


@query("partial_distance", f"WITH {SQL_REFS64} SELECT a.id AS a_id, b.id AS b_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[2] * p[2] - 2 * p[1] * p[2])) AS BIGINT) AS part FROM refs a JOIN refs b ON a.id % 50 = 0 AND b.id <> a.id")
def partial_distance(spark, d):
    """Ranking keys of the pairs of l2_pairwise: distances without the query's norm."""
    return _pairs(spark, d, V.partial_distance).withColumnRenamed("d2", "part")


@query("quantize_vec_away", "SELECT vec_id, list_transform(embedding, lambda e: CAST(CASE WHEN e < 0 THEN -1e0 ELSE 1e0 END * floor(abs(CAST(e AS DOUBLE)) * 10000e0 + 0.5e0) AS BIGINT)) AS q FROM embeddings")
def quantize_vec_away(spark, d):
    return read(spark, d, "embeddings").select("vec_id", V.quantise_away(F.col("embedding")).alias("q"))


@query("count_of_score", f"{HALVES}, v AS (SELECT qid, CAST(sum(CAST(rf AS INT)) AS INT) AS c FROM nn GROUP BY qid) SELECT qid AS query_id, c AS fraud_count FROM v")
def count_of_score(spark, d):
    """Votes told back from scores."""
    return knn_verdict(spark, d).select("query_id", F.round(F.col("fraud_score") * 5).cast("int").alias("fraud_count"))


@query("knn_brute_count", f"{HALVES} SELECT qid AS query_id, CAST(sum(CAST(rf AS INT)) AS INT) AS fraud_count, max(d2) AS kth_d2 FROM nn GROUP BY qid")
def knn_brute_count(spark, d):
    return K.vote(K.knn_join(*_halves(spark, d), 5))


@query("knn_brute_neighbors", f"{HALVES} SELECT qid AS query_id, CAST(rk AS INTEGER) AS rank, rid AS ref_id, d2, rf AS ref_fraud FROM nn")
def knn_brute_neighbors(spark, d):
    return K.knn_join(*_halves(spark, d), 5)


@query("knn_single", f"WITH {SQL_REFS64} SELECT b.id AS ref_id, {sql_d2('a.q', 'b.q')} AS d2, b.f AS ref_fraud FROM refs a JOIN refs b ON a.id = (SELECT min(id) FROM refs) AND b.id <> a.id ORDER BY d2, ref_id LIMIT 5")
def knn_single(spark, d):
    r = refs64(spark, d)
    one = r.orderBy("id").limit(1)
    pairs = r.alias("b").join(F.broadcast(one.alias("a")), F.col("a.id") != F.col("b.id"))
    return pairs.select(F.col("b.id").alias("ref_id"), V.l2_squared(F.col("a.q"), F.col("b.q")).alias("d2"), F.col("b.f").alias("ref_fraud")).orderBy("d2", "ref_id").limit(5)


@query("knn_verdict", f"{HALVES}, v AS (SELECT qid, CAST(sum(CAST(rf AS INT)) AS INT) AS c FROM nn GROUP BY qid) SELECT qid AS query_id, c AS fraud_count, c < 3 AS approved, c / 5e0 AS fraud_score FROM v")
def knn_verdict(spark, d):
    return K.verdict(K.vote(K.knn_join(*_halves(spark, d), 5))).drop("kth_d2")


@query("verdict_json", f"{HALVES}, v AS (SELECT qid, CAST(sum(CAST(rf AS INT)) AS INT) AS c FROM nn GROUP BY qid) SELECT qid AS query_id, '{{\"approved\":' || CASE WHEN c < 3 THEN 'true' ELSE 'false' END || ',\"fraud_score\":' || ['0.0', '0.2', '0.4', '0.6', '0.8', '1.0'][c + 1] || '}}' AS body FROM v")
def verdict_json(spark, d):
    return knn_verdict(spark, d).select("query_id", F.to_json(F.struct("approved", "fraud_score")).alias("body"))


@query("gather_labels", f"{HALVES} SELECT n.qid AS query_id, list(e.label ORDER BY n.rk) AS labels FROM nn n JOIN embeddings e ON e.vec_id = n.rid GROUP BY n.qid")
def gather_labels(spark, d):
    near = K.knn_join(*_halves(spark, d), 5)
    both = near.join(read(spark, d, "embeddings").select(F.col("vec_id").alias("ref_id"), "label"), "ref_id")
    return both.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("labels"))


@query("topk_overlap", f"WITH {SQL_REFS64}, sub AS (SELECT * FROM refs WHERE id % 4 <> 0), {sql_nn('n1', 'refs', 'refs', 5)}, {sql_nn('n2', 'refs', 'sub', 5)} SELECT r.id AS vec_id, CAST(count(n2.rid) AS INTEGER) AS overlap FROM refs r LEFT JOIN n1 ON n1.qid = r.id LEFT JOIN n2 ON n2.qid = r.id AND n2.rid = n1.rid GROUP BY r.id")
def topk_overlap(spark, d):
    r = refs64(spark, d)
    ids = lambda refs, name: K.knn_join(r, refs, 5, exclude_self=True).groupBy("query_id").agg(F.collect_set("ref_id").alias(name))
    both = ids(r, "a").join(ids(r.where("id % 4 <> 0"), "b"), "query_id")
    return both.select(F.col("query_id").alias("vec_id"), F.size(F.array_intersect("a", "b")).alias("overlap"))
