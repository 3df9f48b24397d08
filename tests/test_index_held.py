"""Search of a small index on the spot: equal to the search in blocks, and no row of a request moves for it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.functions import neural
from vicinal.operators import cascade, ivf, knn
from vicinal.plans.features_q import LISTS, PROBES, ROUTER, TAU
from vicinal.plans.fixtures import bodies, index, refs14


def _index(spark, q, lists):
    refs = spark.createDataFrame([(i, x.tolist(), i % 3 == 0) for i, x in enumerate(q)], "id long, q array<long>, f boolean")
    centroids = ivf.seeds(refs, lists)
    return refs, ivf.assign(refs, centroids).drop("d2"), centroids


@pytest.mark.parametrize(("n", "top", "nprobe"), [(300, 10000, 4), (40, 3, 2), (6, 3, 8), (90, 3 * 10**8, 3)])
def test_votes_as_search(spark, n, top, nprobe, monkeypatch):
    monkeypatch.setattr(ivf, "HELD_BLOCK", 1000)  # several blocks a batch
    monkeypatch.setattr(ivf, "HELD_REFS", 70)
    refs, postings, centroids = _index(spark, np.random.default_rng(n).integers(0, top, (n, 5)), min(n, 8))
    found = {r.query_id: r.fraud_count for r in knn.vote(ivf.search(refs, postings, centroids, 5, nprobe, exclude_self=False)).collect()}
    asked = refs.withColumn("q", F.when(F.col("id") % 7 != 1, F.col("q")))
    got = asked.select("id", ivf.votes(ivf.held(postings, centroids), 5, nprobe)("q").alias("v")).collect()
    assert {r.id: r.v for r in got} == {r.id: 0 if r.id % 7 == 1 else found[r.id] for r in got}


def test_large_index_is_not_held(spark, monkeypatch):
    _, postings, centroids = _index(spark, np.arange(60).reshape(12, 5), 3)
    assert ivf.held(postings, centroids) is not None
    monkeypatch.setattr(ivf, "HELD", 59)
    assert ivf.held(postings, centroids) is None


def test_verdicts_move_no_row(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    made = cascade.routed(bodies(spark, sf).withColumnRenamed("id", "key"), neural.Mlp.literal(ROUTER).udf(), TAU)
    held = cascade.verdicts(made, *index(spark, sf, refs14, LISTS), 5, PROBES)
    exchanges = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("Join") + df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(held) == exchanges(made)
    monkeypatch.setattr(ivf, "HELD", 0)
    joined = cascade.verdicts(made, *index(spark, sf, refs14, LISTS), 5, PROBES)
    assert sorted(held.collect()) == sorted(joined.collect()) and held.where("slow").count() > 100


def test_empty_index(spark):
    refs = spark.createDataFrame([], "id long, q array<long>, f boolean")
    none = ivf.Held(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, 0), np.int64), np.zeros(0, bool))
    asked = spark.createDataFrame([(1, [1, 2]), (2, None)], "id long, q array<long>")
    assert [r.v for r in asked.select(ivf.votes(none, 5, 2)("q").alias("v")).collect()] == [0, 0]
    assert ivf.held(refs.withColumn("cluster_id", F.lit(0)), refs.select(F.lit(0).alias("cluster_id"), F.col("q").alias("c"))) is not None


@pytest.mark.parametrize(("n", "top", "piece"), [(400, 10000, 300), (60, 3, 100), (50, 3 * 10**8, 64)])
def test_pieces_of_a_large_index(spark, n, top, piece, monkeypatch):
    """An index that is not held whole is searched in pieces, as it is by a join."""
    monkeypatch.setattr(ivf, "HELD", 10)
    monkeypatch.setattr(ivf, "PIECE", piece)
    refs, postings, centroids = _index(spark, np.random.default_rng(n).integers(0, top, (n, 5)), 6)
    some = ivf.pieces(postings, centroids)
    assert len(some) > 2 and sum(len(x.value.rid) for x in some) == n
    found = {r.query_id: r.fraud_count for r in knn.vote(ivf.search(refs, postings, centroids, 5, 3, exclude_self=False)).collect()}
    assert {r.id: r.v for r in refs.select("id", ivf.votes(some, 5, 3)("q").alias("v")).collect()} == found


def test_large_index_moves_no_row(spark, monkeypatch):
    """Verdicts over an index of any size write nothing and join nothing: before, requests went to each cluster they probe."""
    _, postings, centroids = _index(spark, np.arange(70).reshape(5, 14), 3)
    monkeypatch.setattr(ivf, "HELD", 0)
    made = spark.createDataFrame([(1, False, [3] * 14, [0.0, 0.1, 0.9], True)], "key long, malformed boolean, q array<long>, p array<double>, slow boolean")
    plan = cascade.verdicts(made, postings, centroids, 5, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Generate" not in plan
    assert cascade.verdicts(made, postings, centroids, 5, 3).count() == 1
    assert cascade.verdicts(made, postings, centroids, 5, 3).first().fraud_count == 2


@pytest.mark.parametrize("top", [1, 50, 10000, 10**7])
def test_roundings_lose_no_neighbour(top, monkeypatch):
    """Neighbours that a product in float32 can't tell apart are told apart by integers."""
    monkeypatch.setattr(ivf, "HELD_REFS", 100)
    rng = np.random.default_rng(top)
    r, q = rng.integers(0, top + 1, (900, 14)) + 10**7, rng.integers(0, top + 1, (70, 14)) + 10**7
    q[:5] -= 2 * 10**7  # far from all
    c, f = r[:4], rng.random(900) < 0.5
    of = ivf.squared_distances(r, c).argmin(axis=1)
    index, best = ivf.Held(np.arange(4), c, of, np.arange(900), r, f), ivf.Best(70, 5)
    near = index.probes(q, 2)
    index.nearest(q, near, best)
    d = ((q[:, None] - r[None]) ** 2).sum(axis=2)
    for i in range(70):
        asked = np.flatnonzero(np.isin(of, near[i]))
        first = asked[np.lexsort((asked, d[i][asked]))][:5]
        assert best.d[i][: len(first)].tolist() == d[i][first].tolist() and best.id[i][: len(first)].tolist() == first.tolist()
