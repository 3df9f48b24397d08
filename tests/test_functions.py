import json
import math

import numpy as np
from pyspark.sql import functions as F

from vicinal.functions import features, neural, vectors


def test_rounding_and_distances(spark):
    df = spark.createDataFrame([(0.00005, -0.00005, [3, 4], [0, 0])], "a double, b double, x array<long>, y array<long>")
    vectors.register_sql(spark)
    r = df.select(
        vectors.round_half_away(F.col("a")), vectors.round_half_away(F.col("b")), vectors.l2_squared(F.col("x"), F.col("y")), vectors.l2_squared_by_norms(F.col("x"), F.col("y")),
        vectors.quantise_even(F.array(F.lit(0.00025), F.lit(0.00035))), F.expr("l2sq(x, y)"), F.round(F.expr("gelu(1D)"), 6),
    ).first()
    assert list(r) == [0.0001, -0.0001, 25, 25, [2, 4], 25, 0.841192]


def _body(**over):
    p = {
        "id": "t", "transaction": {"amount": 100.0, "installments": 6, "requested_at": "2026-03-09T23:00:00Z"}, "customer": {"avg_amount": 50.0, "tx_count_24h": 4, "known_merchants": ["M1"]},
        "merchant": {"id": "M1", "mcc": "7995", "avg_amount": 200.0}, "terminal": {"is_online": True, "card_present": False, "km_from_home": 2500.0}, "last_transaction": None,
    }
    for k, v in over.items():
        p[k] = {**p[k], **v} if isinstance(p[k], dict) and v is not None else v
    return json.dumps(p)


def _vec(spark, *bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "key long, body string")
    made = features.vectorise(features.parse(df))
    return [(r.malformed, r.vec) for r in made.orderBy("key").collect()]


def test_features(spark):
    last = lambda t: _body(last_transaction={"timestamp": t, "km_from_current": 500.0})
    got = _vec(
        spark, _body(), last("2026-03-09T22:00:00Z"), last("2026-03-09T23:00:59Z"), last("2026-03-09T23:01:01Z"), _body(customer={"avg_amount": 0.0}),
        _body(customer={"avg_amount": 0.0}, transaction={"amount": 0.0}), _body(merchant={"id": "M9", "mcc": "1"}), '{"id": "x', "",
    )
    v = got[0][1]
    assert v == [0.01, 0.5, 0.2, 1.0, 0.0, -1.0, -1.0, 1.0, 0.2, 1.0, 0.0, 0.0, 0.85, 0.02]
    assert got[1][1][5:7] == [round(60 / 1440, 4), 0.5]
    assert got[2][1][5] == 0.0  # 59 seconds early are no minute
    assert got[3][1][5:7] == [-1.0, -1.0]  # 61 seconds early are a minute too early
    assert got[4][1][2] == 1.0 and got[5][1][2] == 0.0
    assert got[6][1][11:13] == [1.0, 0.5]
    assert [m for m, _ in got] == [False] * 7 + [True, True]


def test_mlp(spark):
    net = neural.Mlp.literal((4, 8, 8, 3))
    assert neural.Mlp.unflat(net.flat(), (4, 8, 8, 3)).flat() == net.flat()
    x = np.array([[0.1, -0.2, 0.3, 0.4]])
    df = spark.createDataFrame([([0.1, -0.2, 0.3, 0.4], 0.7)], "v array<double>, z double")
    p, t, g = df.select(net.udf()("v"), neural.pade_tanh(F.col("z")), neural.gelu(F.col("z"))).first()
    assert np.allclose(p, net.forward(x)[0]) and abs(sum(p) - 1) < 1e-9
    assert abs(t - math.tanh(0.7)) < 1e-6 and abs(g - 0.7 * 0.5 * (1 + math.erf(0.7 / math.sqrt(2)))) < 1e-3


def test_training_learns():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (1500, 4))
    y = (x[:, 0] > 0.2).astype(int) + (x[:, 1] > 0.5)
    net = neural.train_mlp(x, y, (4, 16, 3), epochs=150, rate=0.02, batch=128, patience=40)
    assert (net.forward(x).argmax(1) == y).mean() > 0.93


def test_malformed_bodies_never_stop_a_batch(spark):
    whole = json.loads(_body(last_transaction={"timestamp": "2026-03-09T22:00:00Z", "km_from_current": 5.0}))
    bad = []
    for part, name in (f.split(".") for f in features.REQUIRED):
        bad.append(json.dumps({**whole, part: {k: v for k, v in whole[part].items() if k != name}}))
    bad += [json.dumps({k: v for k, v in whole.items() if k != part}) for part in ("transaction", "customer", "merchant", "terminal")]
    for at in ("2026-03-09T23", "x", "", "2026-13-40T25:61:61Z"):
        bad.append(_body(transaction={"requested_at": at}))
        bad.append(_body(last_transaction={"timestamp": at, "km_from_current": 1.0}))
    bad += [json.dumps({**whole, "last_transaction": {"timestamp": "2026-03-09T22:00:00Z"}}), "null", "[]", "7", "{}", json.dumps({**whole, "transaction": "x"})]
    got = _vec(spark, *bad, json.dumps(whole), _body(), json.dumps({k: v for k, v in whole.items() if k != "last_transaction"}))
    assert [m for m, _ in got] == [True] * len(bad) + [False] * 3
    assert all(x is not None for _, v in got[-3:] for x in v)


def test_binary_network_learns():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (1200, 4))
    y = (x[:, 0] + x[:, 1] > 0.3).astype(int)
    net = neural.train_binary(x, y, hidden=(16, 16, 16), epochs=40, rate=5e-3, batch=64)
    p = net.forward(x)
    assert p.shape == (1200, 1) and ((p[:, 0] >= 0.5) == (y == 1)).mean() > 0.93 and net.exact
    assert abs(float(neural.erf(np.array([0.5]))[0]) - math.erf(0.5)) < 1e-12
    # with one class guarded, the epoch that loses fewest of its rows is kept
    y3 = np.where(x[:, 0] > 0.4, 2, y)
    guard = neural.train_mlp(x, y3, (4, 16, 3), epochs=60, rate=0.02, batch=128, patience=60, guarded=2)
    plain = neural.train_mlp(x, y3, (4, 16, 3), epochs=60, rate=0.02, batch=128, patience=60)
    lost = lambda n: int((n.forward(x[y3 == 2]).argmax(1) != 2).sum())
    assert lost(guard) <= lost(plain)


def test_percentiles_are_elements(spark):
    from vicinal.operators.evaluate import exact_percentile

    for n in (1, 2, 3, 50, 99, 100, 101, 200, 1000):
        df = spark.range(n).select((F.col("id") * 3).cast("double").alias("x"))
        got = df.agg(*[exact_percentile("x", p).alias(f"p{i}") for i, p in enumerate((50, 90, 95, 99, 99.9))]).first()
        assert [int(v) // 3 for v in got] == [min(n * p // 1000, n - 1) for p in (500, 900, 950, 990, 999)]
