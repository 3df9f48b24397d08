import hashlib
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from vicinal.llm import fingerprints, topk_search
from vicinal.llm.textkit import Words, gram_hashes, slices


def _top(rows, k, chosen):
    out = set()
    for i, v in rows:
        if not chosen(i):
            continue
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i and len(w) == len(v))
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best[:k])}
    return out


def test_topk_matches_brute_force_with_ties(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(-9, 9) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [9, 9, 9, 9, 9, 9]) for i in range(120)]  # one vector many times
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = topk_search.top_k(df.where("id % 7 = 0"), df, 5, query_block=20, candidate_block=150)
    assert {tuple(r)[:4] for r in got.collect()} == _top(rows, 5, lambda i: i % 7 == 0)


def test_topk_nulls_lengths_and_empty(spark):
    rows = [(1, [1.0, 0.5]), (2, [2.0, None]), (3, None), (None, [1.0, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [-1.0, 1.0]), (7, [1.0, 1.0, 1.0])]
    df = topk_search.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")), "vec_id", "embedding")
    assert {r.id for r in df.collect()} == {1, 6, 7}
    assert {tuple(r)[:4] for r in topk_search.top_k(df, df, 3).collect()} == {(1, 1, 6, -64 * 64 + 32 * 64), (6, 1, 1, -64 * 64 + 32 * 64)}
    none = df.where("id < 0")
    assert topk_search.top_k(none, df, 3).count() == 0 and topk_search.top_k(df, none, 3).count() == 0


def test_bounds_stop_before_the_end_and_stay_exact():
    rng = np.random.default_rng(2)
    x = rng.integers(-30, 30, (2000, 4))
    q = rng.integers(-30, 30, (5, 4))
    r, c, s, depth = topk_search.nra_block(np.arange(5) - 10, q, np.arange(2000), x, 20)
    assert depth.max() < 1  # read in part
    full = q @ x.T
    for i in range(5):
        order = np.lexsort((np.arange(2000), -full[i]))[:20]
        assert (c[r == i] == order).all() and (s[r == i] == full[i][order]).all()
    huge = x * 2**50  # beyond what doubles hold, by the same method
    c2, s2, d2 = topk_search.nra_block(np.arange(5) - 10, q, np.arange(2000), huge, 20)[1:]
    assert (c2 == c).all() and (s2 == s * 2**50).all() and d2.max() < 1
    for n in (1, 7, 20, 21, 50):  # few candidates, ties
        few = rng.integers(-2, 2, (n, 3))
        r, c, s, _ = topk_search.nra_block(np.arange(4), rng.integers(-2, 2, (4, 3)) * 0 + 1, np.arange(n), few, 20)
        for i in range(4):
            order = [j for j in np.lexsort((np.arange(n), -few.sum(1))) if j != i][:20]
            assert c[r == i].tolist() == order
    big = np.full((3, 2), 2**31)
    assert (topk_search.nra_block(np.array([-1]), big[:1], np.arange(3), -big, 2)[2] == -(2**63)).all()


def test_fingerprint_is_homomorphic(spark):
    a, b, ab, ba = (fingerprints.fingerprint_lanes(pa.array([t])) for t in ("one two three\nfour", "five six seven eight", "one two three\nfour\nfive six seven eight", "five six seven eight\none two three\nfour"))
    code = lambda x: fingerprints.encode_lanes(x)[0]
    assert (ab == ba).all() and fingerprints.combine(code(a), code(b)) == code(ab) and fingerprints.combine(code(ab), code(b), -1) == code(a)
    assert not (a == b).all()
    assert fingerprints.fingerprint_lanes(pa.array(["", None])).sum() == 0
    df = spark.createDataFrame([(1, "a\nb", "x")], "doc_id long, text string, fingerprint string")
    assert fingerprints.fingerprint_documents(df).first().fingerprint == code(fingerprints.fingerprint_lanes(pa.array(["b\na"])))


def test_edited_texts(spark):
    rng = random.Random(4)
    texts = ["\n".join(" ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 99)) for _ in range(20)) for _ in range(5)) for _ in range(60)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "é" * 9), (1003, "x y " * 60000), (2000, texts[0]), (2001, texts[0])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit(1)).withColumn("extra", F.lit("e")).repartition(5)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(df).collect()}
    rows = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        assert got[i].text == t and got[i].edited == t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[2000].fingerprint == got[2001].fingerprint and got[2000].near_next == 1.0
    near = [got[i].near_edited - got[i].near_next for i, _ in rows[:59]]
    assert min(near) > 0.1
    assert fingerprints.edited_fingerprints(df.limit(0)).count() == 0
    one = fingerprints.edited_fingerprints(df.where("doc_id = 1002")).first()
    assert one.edited == "é" * 9 and one.near_edited == one.near_next == 1.0


def test_hot_ids_and_texts_without_end(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("abcdefgh") * 3 for _ in range(6))
    rows = [(rng.choice([None, None, 7, 7, 7, i]), text()) for i in range(600)] + [(None, "same"), (None, "same"), (7, None), (7, "")]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    signed = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63
    rows = sorted(((i is not None, i or 0, signed(t or ""), t or "") for i, t in rows))
    want = [(i if known else None, t, t[: len(t) - len(t) // 2] + rows[(n + 1) % len(rows)][3][: len(t) // 2]) for n, (known, i, _, t) in enumerate(rows)]
    assert sorted(((r.doc_id or -1, r.text, r.edited) for r in got)) == sorted((i or -1, t, e) for i, t, e in want)
    runs = {r.run for r in fingerprints.with_successor(spark.createDataFrame([(None, text()) for _ in range(90)], "doc_id long, text string")).select("run").collect()}
    assert len(runs) > 4
    a, b = (fingerprints.fingerprint_lanes(pa.array([t])) for t in ("a b c " * 40000, "a b c " * 39000))
    assert 0.99 < fingerprints.likeness(a, b)[0] < 1


def test_words_and_grams():
    col = pa.array(["A b\tc", None, "", " x ", "é ü ö\nz"])
    words = [bytes(buf[s:e]).decode() for _, _, buf, offs in slices(col) for w in [Words(buf, offs)] for s, e in zip(w.starts, w.ends, strict=True)]
    assert words == ["A", "b", "c", "x", "é", "ü ö", "z"]
    _, _, buf, offs = next(slices(col))
    w = Words(buf, offs)
    grams, docs = gram_hashes(w.hashes(lower=True), w.bounds, 2)
    assert sorted(docs.tolist()) == [0, 0, 3, 4, 4] and len(set(grams.tolist())) == 5
    assert hashlib  # texts are hashed by value elsewhere
