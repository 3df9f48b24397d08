import gzip
import json

import numpy as np
from pyspark.sql import functions as F

from vicinal.functions.neural import Mlp
from vicinal.operators import ivf
from vicinal.plans.artefacts import build
from vicinal.sources import synthetic, tables
from vicinal.streaming import scoring

from .test_functions import _body


def test_labelled_vectors(spark, tmp_path):
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump([{"vector": [0.1, -1], "label": "fraud"}, {"vector": [0.2, 1], "label": "legit"}], f)
    got = sorted((r.q, r.is_fraud) for r in tables.labelled_vectors(spark, str(tmp_path / "r.json.gz")).collect())
    assert got == [([1000, -10000], True), ([2000, 10000], False)]


def test_corpus_raw_and_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"entries": [{"request": json.loads(_body()), "expected_approved": True}], "stats": {"total": 1}}))
    r = tables.replay_corpus(spark, str(tmp_path / "c.json")).first()
    assert r["index"] == 0 and r.expected_approved and r.merchant.mcc == "7995"
    np.arange(8, dtype="<f4").tofile(tmp_path / "v.bin")
    assert [x.vec for x in tables.raw_vectors(spark, str(tmp_path / "v.bin"), 3, 4).orderBy("id").collect()] == [[0, 1, 2], [4, 5, 6]]
    assert tables.Settings.from_env({"BOX_K": "7", "HALO": "0.5"}) == tables.Settings(box_k=7, halo=0.5)
    tables.write_series(spark.createDataFrame([(1, 2.0)], "t int, x double"), str(tmp_path / "s"), ("t", "x"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).first().x == "2.000"


def test_synthetic(spark):
    u = synthetic.uniform(spark, 200)
    r = u.select(F.min(F.array_min("vec")), F.max(F.array_max("vec")), F.avg((F.col("vec")[5] < 0).cast("int"))).first()
    assert r[0] == -1.0 and r[1] <= 1.0 and 0.05 < r[2] < 0.4
    assert synthetic.perturbed(synthetic.gaussian(spark, 50)).count() == 50


def test_artefacts_and_scoring_stream(spark, tmp_path):
    refs = spark.range(60).select("id", F.array(*[(F.col("id") * (7 + j) % 100 * 100).cast("long") for j in range(14)]).alias("q"), (F.col("id") % 3 == 0).alias("f"))
    made = build(spark, refs, str(tmp_path / "a"), tables.Settings(box_k=5, nlist=4, rounds=2))
    assert made["postings"].count() == made["boxes"].where("box = 2").count()
    again = build(spark, refs.limit(0), str(tmp_path / "a"), tables.Settings(box_k=5, nlist=4, rounds=2))
    assert again["boxes"].count() == 60 and again["offsets"].count() == 4
    fresh = build(spark, refs.limit(30), str(tmp_path / "a"), tables.Settings(box_k=5, nlist=4, rounds=2), force=True)
    assert fresh["boxes"].count() == 30
    made = build(spark, refs, str(tmp_path / "b"), tables.Settings(box_k=5, nlist=4, rounds=2))
    src = tmp_path / "in"
    spark.createDataFrame([(1, _body()), (2, "{"), (3, _body(transaction={"requested_at": "x"}))], "key long, body string").write.json(str(src))
    stream = spark.readStream.schema("key long, body string").json(str(src))
    router = Mlp.literal((14, 8, 3)).udf()
    q = scoring.start_scoring(stream, str(tmp_path / "out"), str(tmp_path / "cp"), postings=made["postings"], centroids=made["centroids"], router=router, tau=0.0, nprobe=4)
    q.awaitTermination(120)
    got = {r.key: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {1, 2, 3} and got[3].approved and got[2].approved and got[2].fraud_count == 0


def test_latency_stream_equals_batch(spark, tmp_path):
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") / 10).alias("ts"), F.col("id").cast("double").alias("value"))
    df.write.parquet(str(tmp_path / "in"))
    stream = scoring.latency_series(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latency").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("latency").collect()) == sorted(scoring.latency_series(spark.read.parquet(str(tmp_path / "in"))).collect())


def test_index_round_trip(spark, tmp_path):
    refs = spark.range(20).select("id", F.array(F.col("id")).alias("q"), F.lit(True).alias("f"))
    cents = ivf.kmeans(refs, 2, 2)
    ivf.write_index(ivf.assign(refs, cents), cents, str(tmp_path / "i"))
    posts, c = ivf.read_index(spark, str(tmp_path / "i"))
    assert posts.count() == 20 and c.count() == 2 and ivf.search(refs, posts, c, 3, 2).count() == 60


def test_stale_tables_are_made_again(spark, tmp_path):
    first, second = str(tmp_path / "first"), str(tmp_path / "second")
    one = lambda n: lambda: spark.range(n)
    tables.materialise_once(spark, first, one(3))
    assert tables.materialise_once(spark, second, one(4), after=(first,)).count() == 4
    assert tables.materialise_once(spark, second, one(5), after=(first,)).count() == 4
    tables.materialise_once(spark, first, one(3), force=True)
    assert tables.materialise_once(spark, second, one(6), after=(first,)).count() == 6


def test_repeated_keys_keep_their_own_verdicts(spark):
    from vicinal.operators import cascade

    q = lambda x: [x] * 14
    made = spark.createDataFrame([(7, False, q(0), [0.0, 0.0, 1.0], True), (7, False, q(10000), [0.0, 0.0, 1.0], True), (7, False, q(0), [0.0, 0.0, 1.0], True), (8, True, q(0), [0.0, 0.0, 1.0], False)], "key long, malformed boolean, q array<long>, p array<double>, slow boolean")
    refs = spark.createDataFrame([(i, q(0 if i < 5 else 10000), i >= 5) for i in range(10)], "id long, q array<long>, f boolean")
    cents = ivf.kmeans(refs, 2, 2)
    got = sorted((r.key, r.fraud_count, r.approved) for r in cascade.verdicts(made, ivf.assign(refs, cents), cents, 5, 2).collect())
    assert got == [(7, 0, True), (7, 0, True), (7, 5, False), (8, 0, True)]


def test_large_clusters_are_split(spark, monkeypatch):
    from vicinal.operators import knn

    monkeypatch.setattr(ivf, "POSTING_BLOCK", 7)
    refs = spark.range(90).select("id", F.array((F.col("id") * 37 % 11).cast("long"), (F.col("id") % 7).cast("long")).alias("q"), (F.col("id") % 2 == 0).alias("f"))
    cents = ivf.kmeans(refs, 2, 3)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(ivf.search(refs, ivf.assign(refs, cents), cents, 4, 2)) == rows(knn.knn_join(refs, refs, 4, exclude_self=True))
    assert ivf.seeds(refs, 3, seed=1).count() == 3 and rows(ivf.seeds(refs, 3, seed=1)) == rows(ivf.seeds(refs, 3, seed=1))


def test_generators_files_and_models(spark, tmp_path):
    state, want = 42, []
    for _ in range(30 * 14):
        state = (state ^ (state << 13)) & (1 << 64) - 1
        state ^= state >> 7
        state = (state ^ (state << 17)) & (1 << 64) - 1
        want.append((state >> 32) / (2**32 - 1))
    got = [x for r in synthetic.xorshift(spark, 30).repartition(5).orderBy("id").collect() for x in r.vec]
    assert got == want
    refs = synthetic.uniform(spark, 40)
    drawn = synthetic.bootstrap(refs, 100)
    assert drawn.count() == 100 and drawn.select(F.max(F.array_max("vec"))).first()[0] <= 1.0
    tables.write_raw(refs, str(tmp_path / "raw"), 14, 16)
    back = {r.id: r.vec for r in tables.read_packed(spark, str(tmp_path / "raw"), 14).collect()}
    assert all(np.allclose(back[r.id], r.vec) for r in refs.collect()) and len(back) == 40
    assert len(spark.read.parquet(str(tmp_path / "raw")).first().row) == 64
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [r.vec for r in tables.npy_vectors(spark, str(tmp_path / "v.npy")).orderBy("id").collect()] == [[0, 1], [2, 3], [4, 5]]
    net = Mlp.literal((4, 8, 3))
    tables.save_model(spark, str(tmp_path / "models"), "router", (4, 8, 3), net.flat())
    tables.save_model(spark, str(tmp_path / "models"), "other", (4, 3), Mlp.literal((4, 3)).flat())
    sizes, kind, weights = tables.load_model(spark, str(tmp_path / "models"), "router")
    assert Mlp.unflat(weights, sizes).flat() == net.flat() and kind == "tanh"
    (tmp_path / "c.json").write_text(json.dumps({"entries": [], "stats": {"total": 7, "fraud_rate": 0.5}}))
    assert tables.corpus_stats(spark, str(tmp_path / "c.json")).first().total == 7
    tables.write_documents(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().b == "x"


def test_running_confusion_and_horizon(spark, tmp_path):
    rows = [(True, True), (True, False), (False, True), (False, False), (True, None)]
    spark.createDataFrame(rows, "expected_approved boolean, approved boolean").write.parquet(str(tmp_path / "v"))
    stream = spark.readStream.schema("expected_approved boolean, approved boolean").parquet(str(tmp_path / "v"))
    q = scoring.running_confusion(stream).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.outcome: r.n for r in spark.table("running").collect()} == dict.fromkeys(("tn", "fp", "fn", "tp", "error"), 1)
    df = spark.range(-5, 300).select(F.timestamp_seconds(F.col("id") + 1000).alias("ts"), F.col("id").cast("double").alias("value"))
    got = scoring.second_series(df, "1970-01-01 00:16:40").collect()
    assert len(got) == 200 and {r.t_sec for r in got} == set(range(200)) and all(r.n == 1 and r.max_ms == r.t_sec for r in got)
