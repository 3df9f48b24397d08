import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.llm import graph, ngram_join, registry, substring_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def _texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeioust") for _ in range(rng.randint(1, 5)))
    base = [[word() for _ in range(rng.randint(30, 120))] for _ in range(12)]
    passage = [word() for _ in range(40)]
    rows = []
    for b in base:
        for _ in range(rng.randint(1, 7)):
            w = list(b)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
        rows.append(" ".join(b).upper())
        rows.append(" ".join(b[:10] + passage + b[10:20]))
    rows += [rows[0]] * 30 + ["", None, "a b c", "A b C", "a", " \t\n", "one two three four", "x " * 3000, "same " * 50]
    return rows


def _components(texts, k, num, den):
    sets = []
    for t in texts:
        w = words_of((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80), (3, 50)])
def test_join_matches_brute_force(spark, k, num, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)  # groups fall into several blocks
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("node", F.lit(0)).repartition(3)
    got = ngram_join.components(df, k, num, 100).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == _components(texts, k, num, 100)


def test_join_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join.components(df).collect())
    assert got == [(-1, 2, -1), (2, 2, 2), (4, 2, 2), (4, 2, 2), (9, 0, 9)]
    assert ngram_join.components(df.limit(0)).count() == 0
    kept = ngram_join.keep_one(df.withColumn("component_id", F.lit("c")).withColumn("gone_id", F.lit(4))).drop("gone_id")
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 9] and kept.columns == ["doc_id", "text", "component_id"]


def test_graph(spark):
    rng = random.Random(3)
    edges = [(0, i, i + 1) for i in range(40)] + [(1, rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(1, 5, 5)]
    want = {}
    for g in (0, 1):
        root = {}
        for h, a, b in edges:
            if h == g and a != b:
                root.setdefault(a, a), root.setdefault(b, b)
                find = lambda x: x if root[x] == x else find(root[x])  # noqa: B023, E731
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
        want |= {(g, v): find(v) for v in root}
    got = graph.connected_components(spark.createDataFrame(edges, "g int, u long, v long")).collect()
    assert {(r.g, r.node): r.root for r in got} == want and len(got) == len(want)


def test_forest_of_many_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 25)).astype(np.uint64) for _ in range(50)]
    u, v = ngram_join.link_forest(np.arange(50), sets, [sets, [s[: len(s) - -(-45 * len(s) // 100) + 1] for s in sets]], 45, 100)
    link = [[100 * len(set(a) & set(b)) >= 45 * len(set(a) | set(b)) for b in sets] for a in sets]
    root = list(range(50))
    for _ in range(50):
        root = [min(root[j] for j in range(50) if link[i][j]) for i in range(50)]
    assert {i: r for i, r in enumerate(root) if r != i} == dict(zip(u.tolist(), v.tolist(), strict=True))


def _kept(texts, window):
    split = [words_of(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append([x for x, g in zip(w, gone, strict=True) if not g])
    return out


@pytest.mark.parametrize("window,piece", [(35, 4 << 20), (8, 700), (2, 300), (1, 300)])
def test_repeats_match_brute_force(spark, window, piece, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE", piece)  # windows meet within and across slices
    texts = _texts()
    df = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("pos", F.monotonically_increasing_id()).withColumn("spans", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("Text_Hash", F.lit(2)).withColumn("text_spans", F.lit("y"))
    got = substring_dedup.remove_repeats(df.repartition(3), window).orderBy("pos").collect()
    assert [list(r.kept_words) for r in got] == _kept(texts, window)
    assert [r.n_words for r in got] == [len(words_of(t)) for t in texts] and all(r.n_words - r.n_removed == len(r.kept_words) for r in got)
    assert [r.spans for r in got] == [1] * len(texts)


def test_repeats_of_an_empty_table(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), 5).count() == 0


def _thue_morse(n):
    """The Thue-Morse word of 2^n letters and its complement."""
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def _sf(spark, path, texts):
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("n", [10, 11])
def test_thue_morse_words_stay_apart(spark, tmp_path, n):
    one, two = _thue_morse(n)
    same = " ".join(f"w{i}" for i in range(34))
    sf = _sf(spark, tmp_path, [f"{same} {one}", f"{same} {two}", f"x y z {one}", f"x y z {two}"])
    got = registry.op10_substring_dedup(spark, sf).collect()
    assert len(got) == 4 and all(r.n_removed == 0 for r in got)
    got = {r.doc_id: r for r in registry.op3_ngram_join(spark, sf).collect()}
    assert got[2].component_id == 2 and got[3].component_id == 3
    ids = {}
    for r in registry.op7_packing(spark, sf).collect():
        ids.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert sorted(ids[2]) != sorted(ids[3])


def test_equal_hashes_are_told_apart():
    texts = [t for t in _texts() if t is None or len(t) < 2000]
    buf = " ".join(t or "" for t in texts).encode()
    w = substring_dedup.Words(np.frombuffer(buf, np.uint8), np.array([0, len(buf)]))
    heads = substring_dedup._heads(w, 8)
    order, starts, counts = substring_dedup._groups(np.zeros(len(heads), np.uint64), w, buf, heads, 8)
    seen = collections.Counter(tuple(buf.split()[i : i + 8]) for i in heads)
    assert sorted(counts.tolist()) == sorted(seen.values())
    for s, c in zip(starts.tolist(), counts.tolist(), strict=True):
        assert len({tuple(buf.split()[i : i + 8]) for i in heads[order[s : s + c]][:50]}) == 1


def test_frequent_runs_only_move_windows(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "COMMON", 2)
    phrase = "of the and to"
    rng = random.Random(9)
    texts = [" ".join(f"{phrase} {rng.choice('abcdefgh')}{rng.randint(0, 9)}" for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert len(substring_dedup.frequent_runs(df, 6, "text", 4)) >= 1
    got = substring_dedup.remove_repeats(df, 6).orderBy("doc_id").collect()
    assert [list(r.kept_words) for r in got] == _kept(texts, 6)


@pytest.mark.parametrize("name", ["op3_ngram_join", "op10_substring_dedup"])
def test_registered_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = registry.queries()[name](spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
