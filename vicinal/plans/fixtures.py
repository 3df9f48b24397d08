"""The tables of the driver as reference sets, transactions and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import clamp01, quantise
from ..operators import boxes, ivf
from ..sources.tables import once

#: Boxes: neighbours of a count, and the halo in grid steps.
BOX_K, HALO = 25, 1500

# Categories that transactions of the fixture go through in turn; the last is unknown.
MCCS = ("5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311", "5999", "0000")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refs64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, q, f: all 64 dimensions; fraud is a label below 3."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantise(F.col("embedding")).alias("q"), (F.col("label") < 3).alias("f"))


def refs4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, q, f: the first 4 dimensions; fraud is a first component above 300 steps."""
    q = quantise(F.slice("embedding", 1, 4))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), q.alias("q")).withColumn("f", F.col("q")[0] > 300)


def refs14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, q, f: the first 14 dimensions on [0, 1], the domain of transaction features; fraud is a label below 3."""
    unit = F.transform(F.slice("embedding", 1, 14), lambda e: clamp01(e.cast("double") * 2.0 + 0.5))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantise(unit).alias("q"), (F.col("label") < 3).alias("f"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested payload per order: amounts from totals, history from the customer's other orders."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 24) * 3600).alias("at"))
    mine = Window.partitionBy("o_custkey")
    run = mine.orderBy("at", "o_orderkey")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # ordered like run, for one sort and one pass
    text = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    o = o.select(
        "*", (F.sum("cents").over(whole) / (F.count("*").over(whole) * F.lit(10000.0))).alias("average"), F.lag("at").over(run).alias("last"),
        (F.count("*").over(mine.orderBy("at").rangeBetween(-86400, 0)) - 1).cast("int").alias("recent"),
    )
    k = F.col("o_orderkey")
    merchant = lambda x: F.concat(F.lit("M"), (x % 10).cast("string"))
    return o.select(
        k.cast("string").alias("id"),
        F.struct((F.col("cents") / F.lit(10000.0)).alias("amount"), (k % 12 + 1).cast("int").alias("installments"), text(F.col("at")).alias("requested_at")).alias("transaction"),
        F.struct(F.col("average").alias("avg_amount"), F.col("recent").alias("tx_count_24h"), F.array(*[merchant(F.col("o_custkey") + i) for i in range(3)]).alias("known_merchants")).alias("customer"),
        F.struct(merchant(k).alias("id"), F.array(*[F.lit(m) for m in MCCS])[(k % 11).cast("int")].alias("mcc"), ((k % 500) * 7.5).alias("avg_amount")).alias("merchant"),
        F.struct((k % 3 == 0).alias("is_online"), (k % 2 == 0).alias("card_present"), ((k * 37) % 1500).cast("double").alias("km_from_home")).alias("terminal"),
        F.when(F.col("last").isNotNull(), F.struct(text(F.col("last")).alias("timestamp"), ((k * 53) % 1200).cast("double").alias("km_from_current"))).alias("last_transaction"),
    )


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, body: payloads as JSON; of every 50th the second half is missing."""
    made = payloads(spark, sf_dir)
    body = F.to_json(F.struct(*made.columns))
    cut = F.col("id").cast("long") % 50 == 0
    return made.select("id", F.when(cut, F.substring(body, 1, 40)).otherwise(body).alias("body"))


def index(spark: SparkSession, sf_dir: str, refs, nlist: int, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """Postings and centroids over refs (one of the functions above), built once a session and read back."""
    name = f"{sf_dir}/{refs.__name__}/{nlist}/{rounds}"
    cents = once(spark, f"{name}/centroids", lambda: ivf.kmeans(refs(spark, sf_dir), nlist, rounds).coalesce(1))
    posts = once(spark, f"{name}/postings", lambda: ivf.assign(refs(spark, sf_dir), cents).drop("d2").repartition("cluster_id").sortWithinPartitions("cluster_id", "id"))
    return posts, cents


def haloed4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """refs4 with c, box0, opp_d2 and box, made once a session: what sweeps, subsets and simulations go over again and again."""
    return once(spark, f"{sf_dir}/halo", lambda: boxes.haloed(refs4(spark, sf_dir), BOX_K, HALO))


SQL_REFS14 = "refs AS (SELECT vec_id AS id, list_transform(list_slice(embedding, 1, 14), lambda e: CAST(floor(greatest(0e0, least(1e0, CAST(e AS DOUBLE) * 2e0 + 0.5e0)) * 10000e0 + 0.5e0) AS BIGINT)) AS q, label < 3 AS f FROM embeddings)"
SQL_REFS64 = "refs AS (SELECT vec_id AS id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 10000e0 + 0.5e0) AS BIGINT)) AS q, label < 3 AS f FROM embeddings)"
SQL_REFS4 = "r0 AS (SELECT vec_id AS id, list_transform(list_slice(embedding, 1, 4), lambda e: CAST(floor(CAST(e AS DOUBLE) * 10000e0 + 0.5e0) AS BIGINT)) AS q FROM embeddings), refs AS (SELECT id, q, q[1] > 300 AS f FROM r0)"


def sql_d2(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"


def sql_nn(name: str, queries: str, refs: str, k: int, cond: str = "a.id <> b.id") -> str:
    """CTE name(qid, rid, rf, d2, rk): the k nearest of refs for each of queries."""
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, rid) AS rk FROM (
      SELECT a.id AS qid, b.id AS rid, b.f AS rf, {sql_d2('a.q', 'b.q')} AS d2 FROM {queries} a JOIN {refs} b ON {cond})) WHERE rk <= {k})"""


SQL_BOXES = f"""{SQL_REFS4},
 {sql_nn('nn25', 'refs', 'refs', BOX_K)},
 cnt AS (SELECT r.id, r.q, r.f, coalesce(v.c, 0) AS c FROM refs r LEFT JOIN (SELECT qid, CAST(sum(CAST(rf AS INT)) AS INT) AS c FROM nn25 GROUP BY qid) v ON v.qid = r.id),
 box0 AS (SELECT *, CASE WHEN NOT f AND c = 0 THEN 0 WHEN f AND c = {BOX_K} THEN 1 ELSE 2 END AS box0 FROM cnt),
 opp AS (SELECT a.id, min({sql_d2('a.q', 'b.q')}) AS opp_d2 FROM refs a JOIN refs b ON a.f <> b.f GROUP BY a.id),
 halo AS (SELECT x.*, o.opp_d2, CASE WHEN x.box0 <> 2 AND o.opp_d2 < {HALO * HALO} THEN 2 ELSE x.box0 END AS box FROM box0 x LEFT JOIN opp o USING (id))"""

SQL_TX = """o AS (SELECT o_orderkey AS k, o_custkey AS cu, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey % 24) * 3600 AS sec FROM orders),
 w AS (SELECT *, CAST(sum(cents) OVER (PARTITION BY cu) AS BIGINT) / (count(*) OVER (PARTITION BY cu) * 10000e0) AS average,
   lag(sec) OVER (PARTITION BY cu ORDER BY sec, k) AS last,
   CAST(count(*) OVER (PARTITION BY cu ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) - 1 AS INT) AS recent FROM o),
 tx AS (SELECT k, cu, sec, cents / 10000e0 AS amount, CAST(k % 12 + 1 AS INT) AS installments, average, recent, last,
   ['5411','5812','5912','5944','7801','7802','7995','4511','5311','5999','0000'][CAST(k % 11 + 1 AS INT)] AS mcc, (k % 500) * 7.5e0 AS mavg,
   k % 3 = 0 AS is_online, k % 2 = 0 AS card_present, CAST((k * 37) % 1500 AS DOUBLE) AS home, CASE WHEN last IS NOT NULL THEN CAST((k * 53) % 1200 AS DOUBLE) END AS cur,
   list_contains(['M' || CAST(cu % 10 AS VARCHAR), 'M' || CAST((cu + 1) % 10 AS VARCHAR), 'M' || CAST((cu + 2) % 10 AS VARCHAR)], 'M' || CAST(k % 10 AS VARCHAR)) AS known FROM w)"""
