"""Queries on transactions, features and the router."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as T
from ..functions import neural as N
from ..operators import cascade as C
from ..operators import ivf as I
from ..operators import knn as K
from .fixtures import SQL_REFS4, SQL_REFS14, SQL_TX, bodies, haloed4, index, payloads, read, refs4, refs14
from .ivf_q import sql_ivf, sql_search

QUERIES, ORACLE = {}, {}
SIZES, TAU = (4, 8, 8, 3), 0.3


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


_RISK = "CASE mcc " + " ".join(f"WHEN '{m}' THEN {r}e0" for m, r in T.MCC_RISK.items()) + f" ELSE {T.DEFAULT_RISK}e0 END"
_MIN = "CASE WHEN last IS NOT NULL THEN (sec - last) // 60 END"


def _g(x: str) -> str:
    return f"floor(({x}) * 10000e0 + 0.5e0) / 10000e0"


def _c(x: str) -> str:
    return _g(f"greatest(0e0, least(1e0, {x}))")


_DIMS = [
    _c("amount / 10000e0"), _c("installments / 12e0"), _c("CASE WHEN average = 0 THEN CASE WHEN amount > 0 THEN 10e0 ELSE 0e0 END ELSE amount / average END / 10e0"),
    _g("((sec // 3600) % 24) / 23e0"), _g("(isodow(make_timestamp(sec * 1000000)) - 1) / 6e0"), f"CASE WHEN last IS NULL THEN -1e0 ELSE {_c(f'({_MIN}) / 1440e0')} END", f"CASE WHEN last IS NULL THEN -1e0 ELSE {_c('cur / 1000e0')} END",
    _c("home / 1000e0"), _c("recent / 20e0"), "CASE WHEN is_online THEN 1e0 ELSE 0e0 END", "CASE WHEN card_present THEN 1e0 ELSE 0e0 END", "CASE WHEN known THEN 0e0 ELSE 1e0 END", _g(_RISK), _c("mavg / 10000e0"),
]


@query("vectorize_tx", f"WITH {SQL_TX} SELECT k AS tx_id, " + ", ".join(f"{x} AS f{i}" for i, x in enumerate(_DIMS)) + " FROM tx")
def vectorize_tx(spark, d):
    made = T.vectorise(payloads(spark, d))
    return made.select(F.col("id").cast("long").alias("tx_id"), *[F.col("vec")[i].alias(f"f{i}") for i in range(14)])


@query("vectorize_tx_grid", f"WITH {SQL_TX} SELECT k AS tx_id, [" + ", ".join(f"CAST(floor(({x}) * 10000e0 + 0.5e0) AS BIGINT)" for x in _DIMS) + "] AS q FROM tx")
def vectorize_tx_grid(spark, d):
    return T.vectorise(payloads(spark, d)).select(F.col("id").cast("long").alias("tx_id"), "q")


@query("tx_date_parts", f"WITH {SQL_TX} SELECT k AS tx_id, CAST(year(make_timestamp(sec * 1000000)) AS INTEGER) AS y, CAST(month(make_timestamp(sec * 1000000)) AS INTEGER) AS m, CAST(day(make_timestamp(sec * 1000000)) AS INTEGER) AS d, CAST((sec // 3600) % 24 AS INTEGER) AS h, CAST(isodow(make_timestamp(sec * 1000000)) - 1 AS INTEGER) AS weekday, sec AS epoch_s FROM tx")
def tx_date_parts(spark, d):
    at = F.col("transaction.requested_at")
    part = lambda a, n: F.substring(at, a, n).cast("int")
    return payloads(spark, d).select(F.col("id").cast("long").alias("tx_id"), part(1, 4).alias("y"), part(6, 2).alias("m"), part(9, 2).alias("d"), part(12, 2).alias("h"), F.weekday(F.to_date(F.substring(at, 1, 10))).alias("weekday"), T.instant(at).alias("epoch_s"))


@query("minutes_since_last", f"WITH {SQL_TX} SELECT k AS tx_id, coalesce({_MIN}, -1) AS minutes FROM tx")
def minutes_since_last(spark, d):
    return payloads(spark, d).select(F.col("id").cast("long").alias("tx_id"), F.coalesce(T.minutes_between(F.col("last_transaction.timestamp"), F.col("transaction.requested_at")), F.lit(-1)).alias("minutes"))


@query("mcc_risk_lookup", f"WITH {SQL_TX} SELECT k AS tx_id, mcc, {_RISK} AS risk FROM tx")
def mcc_risk_lookup(spark, d):
    return payloads(spark, d).select(F.col("id").cast("long").alias("tx_id"), "merchant.mcc", T.mcc_risk(F.col("merchant.mcc")).alias("risk"))


@query("mcc_risk_join", f"WITH {SQL_TX} SELECT mcc, count(*) AS n, {_RISK} AS risk FROM tx GROUP BY mcc")
def mcc_risk_join(spark, d):
    dim = spark.createDataFrame(sorted(T.MCC_RISK.items()), "mcc string, risk double")
    tx = payloads(spark, d).groupBy("merchant.mcc").agg(F.count("*").alias("n"))
    return tx.join(F.broadcast(dim), "mcc", "left").select("mcc", "n", F.coalesce("risk", F.lit(T.DEFAULT_RISK)).alias("risk"))


@query("array_membership", f"WITH {SQL_TX} SELECT k AS tx_id, known FROM tx")
def array_membership(spark, d):
    return payloads(spark, d).select(F.col("id").cast("long").alias("tx_id"), F.array_contains("customer.known_merchants", F.col("merchant.id")).alias("known"))


@query("malformed_default", f"WITH {SQL_TX} SELECT k AS tx_id, k % 50 = 0 AS malformed, CASE WHEN k % 50 = 0 THEN 0 WHEN amount > 2000e0 THEN 5 ELSE 0 END AS fraud_count, NOT (k % 50 <> 0 AND amount > 2000e0) AS approved FROM tx")
def malformed_default(spark, d):
    made = T.parse(bodies(spark, d).withColumnRenamed("id", "key"))
    count = F.coalesce(F.when(~F.col("malformed"), F.when(F.col("transaction.amount") > 2000.0, 5).otherwise(0)), F.lit(0))
    return made.select(F.col("key").cast("long").alias("tx_id"), "malformed", count.alias("fraud_count"), (count < 3).alias("approved"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _sql_pade(u: str) -> str:
    s = f"(({u}) * ({u}))"
    return f"CASE WHEN abs({u}) >= {N.SATURATED}e0 THEN sign({u}) ELSE ({u}) * (135135e0 + {s} * (17325e0 + {s} * (378e0 + {s}))) / (135135e0 + {s} * (62370e0 + {s} * (3150e0 + {s} * 28e0))) END"


def _sql_gelu(x: str) -> str:
    return f"0.5e0 * {x} * (1e0 + {_sql_pade(f'({N.ROOT_2_PI}e0 * ({x} + {N.CUBIC}e0 * {x} * {x} * {x}))')})"


_X = "x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 20e0 AS x FROM embeddings)"


@query("pade_tanh", f"WITH {_X} SELECT vec_id, round({_sql_pade('x')}, 6) AS y FROM x")
def pade_tanh(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(N.pade_tanh(F.col("embedding")[0].cast("double") * 20.0), 6).alias("y"))


@query("gelu_tanh", f"WITH {_X}, y AS (SELECT vec_id, round({_sql_gelu('x')}, 6) AS y FROM x) SELECT vec_id, CASE WHEN y = 0 THEN 0e0 ELSE y END AS y FROM y")
def gelu_tanh(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(N.gelu(F.col("embedding")[0].cast("double") * 20.0), 6).alias("y")).withColumn("y", F.when(F.col("y") == 0, 0.0).otherwise(F.col("y")))


@query("sigmoid_threshold", f"WITH {_X} SELECT vec_id, round(1e0 / (1e0 + exp(-x)), 6) AS p, x >= 0e0 AS deny FROM x")
def sigmoid_threshold(spark, d):
    x = F.col("embedding")[0].cast("double") * 20.0
    return read(spark, d, "embeddings").select("vec_id", F.round(N.sigmoid(x), 6).alias("p"), (N.sigmoid(x) >= 0.5).alias("deny"))


@query("softmax_route", "WITH l AS (SELECT vec_id, list_transform(list_slice(embedding, 1, 3), lambda e: CAST(e AS DOUBLE) * 10e0) AS z FROM embeddings), e AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM l), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e) SELECT vec_id, list_transform(p, lambda x: round(x, 6)) AS p, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS route FROM p")
def softmax_route(spark, d):
    z = F.transform(F.slice("embedding", 1, 3), lambda e: e.cast("double") * 10.0)
    made = read(spark, d, "embeddings").select("vec_id", N.softmax(z).alias("p"))
    return made.select("vec_id", F.transform("p", lambda x: F.round(x, 6)).alias("p"), (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("route"))


def _sql_layer(n: int, a: int, b: int, src: str) -> str:
    return f"list_transform(range({b}), lambda i: list_sum(list_transform(range({a}), lambda j: (((7 * i + 3 * j + {5 * n}) % 11) - 5) / 10e0 * {src}[CAST(j + 1 AS INT)])) + (((3 * i + {n}) % 5) - 2) / 10e0)"


SQL_ROUTER = f"""{SQL_REFS4}, x0 AS (SELECT id, f, q, list_transform(q, lambda v: v / 10000e0) AS x FROM refs),
 z1 AS (SELECT id, f, q, {_sql_layer(0, 4, 8, 'x')} AS z FROM x0), h1 AS (SELECT id, f, q, list_transform(z, lambda v: {_sql_gelu('v')}) AS x FROM z1),
 z2 AS (SELECT id, f, q, {_sql_layer(1, 8, 8, 'x')} AS z FROM h1), h2 AS (SELECT id, f, q, list_transform(z, lambda v: {_sql_gelu('v')}) AS x FROM z2),
 z3 AS (SELECT id, f, q, {_sql_layer(2, 8, 3, 'x')} AS z FROM h2), e3 AS (SELECT id, f, q, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM z3),
 router AS (SELECT id, f, q, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e3)"""


def routed(spark, d):
    """refs4 with p, the router's probabilities of legit, fraud and boundary."""
    r = refs4(spark, d)
    return r.withColumn("p", N.Mlp.literal(SIZES).udf()(F.transform("q", lambda v: v / F.lit(10000.0))))


@query("router_infer", f"WITH {SQL_ROUTER} SELECT id AS vec_id, list_transform(p, lambda v: round(v, 6)) AS p FROM router")
def router_infer(spark, d):
    return routed(spark, d).select(F.col("id").alias("vec_id"), F.transform("p", lambda v: F.round(v, 6)).alias("p"))


@query("router_train")
def router_train(spark, d):
    """Class and probabilities by a router trained on a bounded sample of boxes."""
    import numpy as np

    boxed = haloed4(spark, d)
    sample = boxed.orderBy(F.xxhash64("id"), "id").limit(5000).select("q", "box0").collect()
    net = N.train_mlp(np.array([r.q for r in sample]) / 10000, np.array([r.box0 for r in sample]), SIZES)
    made = boxed.withColumn("p", net.udf()(F.transform("q", lambda v: v / F.lit(10000.0))))
    return made.select(F.col("id").alias("vec_id"), "box0", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("predicted"))


@query("cascade_score", f"WITH {SQL_ROUTER}, {sql_ivf(16)}, {sql_search(4)} SELECT r.id AS vec_id, r.p[3] > {TAU}e0 AS slow, CAST(CASE WHEN r.p[3] > {TAU}e0 THEN coalesce(v.c, 0) WHEN r.p[1] > r.p[2] THEN 0 ELSE 5 END AS INTEGER) AS fraud_count FROM router r LEFT JOIN votes v ON v.qid = r.id")
def cascade_score(spark, d):
    r = routed(spark, d)
    p = lambda i: F.col("p")[i]
    fast = r.where(p(2) <= TAU).select("id", F.lit(False).alias("slow"), F.when(p(0) > p(1), 0).otherwise(5).alias("fraud_count"))
    slow = r.where(p(2) > TAU).select("id", "q", "f")
    votes = K.vote(I.search(slow, *index(spark, d, refs4, 16), 5, 4)).select(F.col("query_id").alias("id"), "fraud_count")
    searched = slow.select("id").join(votes, "id", "left").select("id", F.lit(True).alias("slow"), F.coalesce("fraud_count", F.lit(0)).alias("fraud_count"))
    return fast.unionByName(searched).withColumnRenamed("id", "vec_id")


ROUTER, LISTS, PROBES = (14, 64, 64, 3), 16, 8


@query("score_requests", f"""WITH {SQL_TX}, {SQL_REFS14}, {sql_ivf(LISTS)}, x0 AS (SELECT k AS id, [{', '.join(_DIMS)}] AS x FROM tx WHERE k % 50 <> 0),
 z1 AS MATERIALIZED (SELECT id, x AS v, {_sql_layer(0, 14, 64, 'x')} AS z FROM x0), h1 AS MATERIALIZED (SELECT id, v, list_transform(z, lambda v: {_sql_gelu('v')}) AS x FROM z1),
 z2 AS MATERIALIZED (SELECT id, v, {_sql_layer(1, 64, 64, 'x')} AS z FROM h1), h2 AS MATERIALIZED (SELECT id, v, list_transform(z, lambda v: {_sql_gelu('v')}) AS x FROM z2),
 z3 AS MATERIALIZED (SELECT id, v, {_sql_layer(2, 64, 3, 'x')} AS z FROM h2), e3 AS (SELECT id, v, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM z3),
 router AS MATERIALIZED (SELECT id, list_transform(v, lambda x: CAST(floor(x * 10000e0 + 0.5e0) AS BIGINT)) AS q, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e3),
 asked AS (SELECT id, q FROM router WHERE p[3] > {TAU}e0), {sql_search(PROBES, '', 'asked', '')},
 r AS (SELECT t.k, t.k % 50 = 0 AS malformed, coalesce(r.p[3] > {TAU}e0, false) AS slow, CAST(CASE WHEN t.k % 50 = 0 THEN 0 WHEN r.p[3] > {TAU}e0 THEN coalesce(v.c, 0) WHEN r.p[1] > r.p[2] THEN 0 ELSE 5 END AS INTEGER) AS fraud_count FROM tx t LEFT JOIN router r ON r.id = t.k LEFT JOIN votes v ON v.qid = t.k)
 SELECT k AS tx_id, malformed, slow, fraud_count, fraud_count < 3 AS approved, fraud_count / 5e0 AS fraud_score FROM r""")
def score_requests(spark, d):
    """The service end to end: JSON bodies, features, the 14-64-64-3 router, the index for what it leaves open, verdicts."""
    made = C.routed(bodies(spark, d).withColumnRenamed("id", "key"), N.Mlp.literal(ROUTER).udf(), TAU)
    return C.verdicts(made, *index(spark, d, refs14, LISTS), 5, PROBES).withColumn("key", F.col("key").cast("long")).withColumnRenamed("key", "tx_id")


@query("feasibility")
def feasibility(spark, d):
    """Confusion by threshold of a binary network that learnt the votes."""
    from .artefacts import feasibility as chain

    return chain(refs4(spark, d), epochs=6)
