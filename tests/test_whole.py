"""Simulations, usage, curves and stress over whole tables against brute force on a small fixture."""

import numpy as np
import pytest

from vicinal.plans.boxes_q import SWEEP
from vicinal.plans.fixtures import BOX_K, HALO
from vicinal.plans.registry import queries
from vicinal.plans.usage_q import SIZES

N = 150


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    v = np.random.default_rng(4).normal(0, 0.12, (N, 4)).astype(np.float32)
    spark.createDataFrame([(i, x.tolist(), i % 5) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, np.floor(v.astype(np.float64) * 10000 + 0.5).astype(np.int64)


def _near(d, ids, k):
    """Rows of ids by distance, then id, for each row of d; far means left out."""
    return [[int(ids[j]) for j in np.lexsort((ids, row)) if row[j] < np.iinfo(np.int64).max][:k] for row in d]


def _d2(a, b, own=False):
    d = ((a[:, None, :] - b[None, :, :]) ** 2).sum(2)
    return np.where(np.eye(len(a), dtype=bool), np.iinfo(np.int64).max, d) if own else d


def _world(q):
    f, d = q[:, 0] > 300, _d2(q, q, True)
    ids = np.arange(N)
    c = np.array([f[x].sum() for x in _near(d, ids, BOX_K)])
    box0 = np.where(~f & (c == 0), 0, np.where(f & (c == BOX_K), 1, 2))
    opp = np.array([d[i][f != f[i]].min() for i in ids])
    return f, d, ids, box0, opp


def _votes(d, inside, f):
    return np.array([f[x].sum() for x in _near(d[:, inside], np.flatnonzero(inside), 5)])


def _usage(d, f, ids, train):
    score = np.zeros(N, int)
    for i in ids[train]:
        near = _near(d[i : i + 1], ids, 5)[0]
        score[near] += 10 if f[near].sum() in (2, 3) else 1
    return score


def test_halo_simulation(spark, sf):
    f, d, ids, box0, opp = _world(sf[1])
    u, want = _votes(d, np.ones(N, bool), f) >= 3, set()
    for limit in SWEEP:
        c = _votes(d, (box0 == 2) | (opp < limit * limit), f) >= 3
        want.add((limit, int((u & c).sum()), int((~u & ~c).sum()), int((~u & c).sum()), int((u & ~c).sum())))
    got = queries()["halo_simulation"](spark, sf[0]).select("limit_steps", "tp", "tn", "fp", "fn").collect()
    assert {tuple(r) for r in got} == want and all(sum(r[1:]) == N for r in got)


def test_usage(spark, sf):
    f, d, ids, box0, _ = _world(sf[1])
    score = _usage(d, f, ids, ids >= 0)
    run = lambda name: queries()[name](spark, sf[0])
    assert {r.ref_id: r.score for r in run("weighted_usage").collect()} == {int(i): score[i] / 10 for i in ids if score[i]}
    assert {tuple(r) for r in run("usage_breakdown").select("box0", "n", "touched", "total").collect()} == {(b, int((box0 == b).sum()), int((score[box0 == b] > 0).sum()), int(score[box0 == b].sum())) for b in set(box0.tolist())}
    assert {r.ref_id for r in run("untouched_b").collect()} == set(ids[(box0 == 2) & (score == 0)].tolist())
    best = {r.ref_id: r["rank"] for r in run("usage_ranking").collect()}
    assert all(best[i] == sum((box0 == box0[i]) & (score > 0) & ((score > score[i]) | ((score == score[i]) & (ids <= i)))) for i in best) and len(best) == (score > 0).sum()


def test_curve(spark, sf):
    f, d, ids, box0, _ = _world(sf[1])
    score, test = _usage(d, f, ids, ids % 3 != 1), ids % 3 == 1
    most = sorted(ids[box0 != 2], key=lambda i: (-score[i], i))
    u = _votes(d, np.ones(N, bool), f) >= 3
    want = {}
    for size in SIZES:
        inside = box0 == 2
        inside[most[:size]] = True
        want[size] = (int(test.sum()), round(float(((_votes(d, inside, f) >= 3) == u)[test].mean()), 6))
    assert {r["size"]: (r.n, r.agreement) for r in queries()["agreement_curve"](spark, sf[0]).collect()} == want


def test_stress(spark, sf):
    q = sf[1]
    f, _, ids, box0, opp = _world(q)
    inside = (box0 == 2) | (opp < HALO * HALO)
    code = lambda j: (ids * 7919 + j * 104729 + 12345) * 31 % 100003
    shapes = {
        "uniform": np.stack([code(j) % 8001 - 4000 for j in range(4)], 1), "gaussian": np.stack([code(j) % 2001 + code(j + 10) % 2001 + code(j + 20) % 2001 - 3000 for j in range(4)], 1),
        "perturbed": q + np.stack([code(j) % 1001 - 500 for j in range(4)], 1),
    }
    got = {r.dist: (r.n, r.exact, r.binary_agreement) for r in queries()["stress_agreement"](spark, sf[0]).collect()}
    for name, x in shapes.items():
        a, b = _votes(_d2(x, q), np.ones(N, bool), f), _votes(_d2(x, q), inside, f)
        assert got[name] == (N, round(float((a == b).mean()), 6), round(float(((a >= 3) == (b >= 3)).mean()), 6))
