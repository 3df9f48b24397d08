import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from vicinal.llm import mixing, registry
from vicinal.llm.runtime import materialise

from .test_dedup import _components, _kept, words_of


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    docs, labels = [], []
    for i in range(240):
        text = " ".join(word() for _ in range(rng.randint(60, 160)))
        if i % 3 == 0:
            text = " | ".join(text.upper().split())
        if i % 20 == 1:
            text = f"{text}\n{passage}"
        docs.append((i, text))
        labels.append((i, int(i % 3 > 0), 0))
    for i in range(240, 260):  # copies with one word changed
        w = docs[i - 239][1].split(" ")
        w[5] = word()
        docs.append((i, " ".join(w)))
    docs += [(260, None), (261, ""), (262, docs[4][1])]
    path = str(tmp_path_factory.mktemp("sf"))
    made = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.char_length("text").cast("long").alias("n_chars"), F.lit(1).alias("score"))
    made.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_match_plain_python(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert len(stages) == 5
    kept = materialise(stages["quality classifier"](spark, docs, tables), "t1")
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = [i for i in range(240) if i % 3]
    assert len(ids & set(clean)) >= 0.98 * len(clean) and len([i for i in ids if i < 240 and i % 3 == 0]) < 10
    single = materialise(stages["n-gram Jaccard join"](spark, kept, tables), "t2")
    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    comps = _components([t for _, t in rows], 5, 80, 100)
    assert sorted(r.doc_id for r in single.collect()) == [rows[n][0] for n, _, c in comps if n == c]
    bare = materialise(stages["substring dedup"](spark, single, tables), "t3")
    assert bare.columns == docs.columns
    rows = sorted((r.doc_id, r.text) for r in single.collect())
    got = {r.doc_id: r for r in bare.collect()}
    for (i, t), words in zip(rows, _kept([t for _, t in rows], 50), strict=True):
        assert words_of(got[i].text) == words and (len(words) < len(words_of(t)) or got[i].text == t)
        assert t is None or got[i].n_chars == len(got[i].text)
    mixed = materialise(stages["mixing sources to target weights"](spark, bare, tables), "t4")
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= set(got)
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    want = _copies(mixing.mixing_rates(bare, labels, kept=mixing.KEPT).collect())
    assert collections.Counter(r.doc_id for r in mixed.collect()) == want
    packed = stages["packing"](spark, mixed, tables).collect()
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    total = collections.Counter()
    for r in packed:
        total[r.doc_id, r.doc_tokens] += r.length
    assert all(n == copies[i] * t for (i, t), n in total.items()) and {i for i, _ in total} == set(copies)


def _copies(rows):
    """How often the mix has each id, by plain Python: the whole part of its rate, and one more below a hash."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    ids = spark.createDataFrame([(r.doc_id,) for r in rows], "doc_id long")
    chance = {r[0]: (r[1] % (1 << 30)) / (1 << 30) for r in ids.select("doc_id", F.xxhash64("doc_id", F.lit("mix"))).collect()}
    made = collections.Counter()
    for r in rows:
        whole = math.floor(r.rate)
        made[r.doc_id] += whole + (chance[r.doc_id] < r.rate - whole)
    return +made


def test_run_over_all_stages_and_registry(spark, tables):
    out = pipeline.run(spark, tables)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, tables), "by-hand")
    pieces = lambda df: collections.Counter((r.doc_id, r.doc_tokens) for r in df.where("start = 0").collect())
    assert pieces(out) == pieces(docs) and out.count() > 100 and out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    names = registry.queries()
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 11)] and "pipeline" in names
    assert pipeline.ORACLE_SQL is None and np is not None
