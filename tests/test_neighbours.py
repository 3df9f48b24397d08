import random

import pytest
from pyspark.sql import functions as F

from vicinal.operators import boxes, ivf, knn

SCHEMA = "id long, q array<long>, f boolean"


@pytest.fixture(scope="module")
def refs(spark):
    random.seed(3)
    rows = [(i, [random.randint(-40, 40) for _ in range(3)], random.random() < 0.4) for i in range(120)]
    return rows, spark.createDataFrame(rows, SCHEMA).cache()


def brute(queries, refs, k, keep):
    out = set()
    for i, q, f in queries:
        near = sorted((sum((a - b) ** 2 for a, b in zip(q, r, strict=True)), j) for j, r, g in refs if keep(i, f, j, g))
        out |= {(i, n + 1, j, d) for n, (d, j) in enumerate(near[:k])}
    return out


def rows(df):
    return {(r.query_id, r["rank"], r.ref_id, r.d2) for r in df.collect()}


@pytest.mark.parametrize("strategy", ["arrow", "sql"])
def test_join_matches_brute_force(refs, strategy):
    data, df = refs
    got = rows(knn.knn_join(df, df, 5, exclude_self=True, strategy=strategy, query_block=50, ref_block=40))
    assert got == brute(data, data, 5, lambda i, f, j, g: i != j)
    got = rows(knn.knn_join(df, df, 1, opposite=True, strategy=strategy, query_block=50, ref_block=40))
    assert got == brute(data, data, 1, lambda i, f, j, g: f != g)


def test_ties_few_references_and_no_rows(spark):
    df = spark.createDataFrame([(3, [0, 1], True), (1, [1, 0], False), (2, [0, -1], True), (9, [0, 0], False)], SCHEMA)
    got = [(r.ref_id, r.d2) for r in knn.knn_join(df.where("id = 9"), df, 2, exclude_self=True).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 1)]
    assert knn.knn_join(df, df, 10, exclude_self=True).count() == 12
    none = df.where("id < 0")
    assert knn.knn_join(none, df, 3).count() == 0 and knn.knn_join(df, none, 3).count() == 0


def test_boxes_and_halo(refs):
    _, df = refs
    made = boxes.haloed(df, 5, 10).collect()
    assert len(made) == 120
    for r in made:
        assert r.box0 == (0 if not r.f and r.c == 0 else 1 if r.f and r.c == 5 else 2)
        assert r.box == (2 if r.box0 != 2 and r.opp_d2 < 100 else r.box0)
    sizes = [boxes.haloed(df, 5, h).where("box = 2").count() for h in (1, 15)]
    assert sizes[0] <= sizes[1]


def test_full_probe_is_exact_and_probes_help(refs):
    _, df = refs
    cents = ivf.kmeans(df, 6, 3)
    posts = ivf.assign(df, cents).drop("d2")
    exact = rows(knn.knn_join(df, df, 5, exclude_self=True))
    assert rows(ivf.search(df, posts, cents, 5, 6)) == exact
    kth = [{r.query_id: r.d for r in ivf.search(df, posts, cents, 5, p).where("rank = 5").select("query_id", F.col("d2").alias("d")).collect()} for p in (2, 4, 6)]
    for a, b in zip(kth, kth[1:], strict=False):
        assert all(b[i] <= d for i, d in a.items())


def test_empty_cluster_keeps_its_centroid(spark):
    df = spark.createDataFrame([(0, [0], True), (1, [1], True)], SCHEMA)
    cents = spark.createDataFrame([(0, [0]), (1, [100])], "cluster_id int, c array<long>")
    got = {r.cluster_id: (r.n, r.c) for r in ivf.update(ivf.assign(df, cents), cents).collect()}
    assert got == {0: (2, [1]), 1: (0, [100])}
