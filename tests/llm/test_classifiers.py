import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vicinal.llm import language_id, license_scan, mixing, quality_cnn


def _prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."


def _labelled(n=400, seed=1):
    rng = random.Random(seed)
    texts, y = [], []
    for i in range(n):
        good = i % 3 > 0
        t = _prose(rng, rng.randint(20, 200))
        texts.append(t if good else " | ".join(t.upper().split()))
        y.append(int(good))
    return texts, y


def test_network_gradient_and_learning():
    rng = np.random.default_rng(0)
    net = quality_cnn.Network.fresh(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    chunks = rng.integers(0, 255, (5, quality_cnn.CHUNK)).astype(np.uint8)
    row, y, w = np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    _, g = net.gradients(chunks, row, y, w)
    for name in ("out", "dense", "conv_b", "conv", "embed"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        net.p[name][at] += 1e-4
        up = net.gradients(chunks, row, y, w)[0]
        net.p[name][at] -= 2e-4
        down = net.gradients(chunks, row, y, w)[0]
        net.p[name][at] += 1e-4
        assert abs((up - down) / 2e-4 - g[name][at]) < 2e-3 * max(1, abs(g[name][at]))


def test_quality_scores(spark):
    texts, y = _labelled()
    docs = [(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, _prose(random.Random(2), 30000)), (None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)] + [(None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    sample_texts, sample_y = quality_cnn.training_sample(df, labels, 1000)
    assert all(len(c) <= quality_cnn.SAMPLE_CHUNKS and c.shape[1] == quality_cnn.CHUNK for c in sample_texts)
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(sample_texts) == len(texts) - len(held) and sorted(sample_y) == sorted(y[i] for i in range(len(y)) if i not in held)
    got = {r.doc_id: r.score for r in quality_cnn.quality_scores(df, labels).collect()}
    assert len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (y[i] == 1) for i in held]) > 0.95
    assert quality_cnn.score_documents(df.limit(0), quality_cnn.Network.fresh(1)).count() == 0
    assert quality_cnn.score_column(quality_cnn.train([], []), pa.array(["a", None])).tolist() == [0.5, 0.5]


def test_chunks_cover_whole_texts():
    text = bytes(range(1, 251)) * 9
    buf = np.frombuffer(text, np.uint8)
    chunks, row = quality_cnn.chunk_matrix(buf, np.array([0, 0, 700, len(buf)]))
    assert row.tolist().count(0) == 1
    for r, (a, b) in enumerate([(0, 0), (0, 700), (700, len(buf))]):
        made = b"".join(bytes(c[: quality_cnn.STEP]) for c in chunks[row == r][:-1]) + bytes(chunks[row == r][-1])
        assert made.rstrip(b"\0") == text[a:b]


@pytest.fixture(scope="module")
def model():
    return license_scan.fit()


def test_license_classifier_held_out(model):
    rng = random.Random(17)
    texts, y = license_scan._examples(99, [_prose(rng, 25) for _ in range(300)])  # other wordings, prose never seen
    units = license_scan._units_of(texts)
    z = license_scan._logits(model["weights"], model["bias"], units) / model["temperature"]
    z[:, -1] += model["unknown"]
    p = license_scan._softmax(z)
    assert (p.argmax(1) == y[units.row]).mean() > 0.95
    sure = p.max(1) > 0.9
    assert (p.argmax(1) == y[units.row])[sure].mean() > 0.97


def test_license_scan(spark, model):
    rng = random.Random(3)
    rows = [
        (1, f"{_prose(rng, 30)}\nReleased under the MIT License.\n{_prose(rng, 30)}"), (2, _prose(rng, 50)), (3, None), (4, ""), (5, "\n\n \n"),
        (6, f"{_prose(rng, 60)} This work is licensed under the GNU General Public License, version 3. {_prose(rng, 60)}"),
        (7, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."), (7, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."), (8, "der mit dem hund"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit(1))
    got = sorted((r.doc_id, r.n_paragraphs, tuple(h.family for h in r.hits if h.confirmed)) for r in license_scan.scan(df, model=model).collect())
    assert got == [(1, 3, ("mit",)), (2, 1, ()), (3, 0, ()), (4, 0, ()), (5, 0, ()), (6, 1, ("gpl",)), (7, 2, ("apache", "cc-by-nc")), (7, 2, ("apache", "cc-by-nc")), (8, 1, ())]
    one = next(h for r in license_scan.scan(df.where("doc_id = 1"), model=model).collect() for h in r.hits if h.confirmed)
    assert one.paragraph == 1 and rows[0][1].encode()[one.start : one.end].decode() == "Released under the MIT License"
    assert license_scan.scan(df.limit(0), model=model).count() == 0


def test_license_notices_apart_in_one_line(spark, model):
    rng = random.Random(4)
    notices = ["This work is licensed under the GNU General Public License version 2.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License."]
    text = " ".join(f"{_prose(rng, 300)} {n}" for n in notices)
    (row,) = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model=model).collect()
    sure = [h for h in row.hits if h.confirmed]
    assert row.n_paragraphs == 1 and [h.family for h in sure] == ["gpl", "gpl", "mit"]
    for h, at in zip(sure, (text.index(n) for n in notices), strict=True):
        assert h.start < at + 40 and h.end > at


WORDS = {"en": "the of and that with this for was are from".split(), "de": "der die und das nicht mit ist ein auf auch".split(), "fr": "le la et les des que est dans pour une".split()}


def _lang(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", " ", "e "]) for _ in range(n))


def test_language_fusion(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(lang, _lang(rng, lang, 60)) for lang in WORDS for _ in range(40)] + [(None, "x"), ("en", None)], "lang string, text string").withColumn("h", F.lit(1))
    pages, want = [], {}
    for i in range(60):
        lang = list(WORDS)[i % 3]
        said = lang if i % 5 else "en"  # wrong at times
        pages.append((i, f"https://www.h{i % 6}.example.{'de' if lang == 'de' else 'org'}/p?q=1", f'<html lang="{said}"><script>the of and</script><body><p>{_lang(rng, lang, 50)}</p></body></html>'))
        want[i] = lang
    pages += [(100, "http://www.h2.example.org/", "<p>12 34</p>"), (101, None, None), (102, "nonsense", ""), (0, *pages[0][1:]), (103, "http://x.example.de/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    rows = language_id.identify(df, docs).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(pages) and all(got[i].language == lang for i, lang in want.items())
    assert got[100].language == want[2] and got[103].language == "de"  # by host, by suffix
    assert got[101].language in WORDS and 0 < got[101].probability <= 1
    assert language_id.identify(df.limit(0), docs).count() == 0
    assert language_id.identify(df.limit(2), docs.limit(0)).first().language == "und"


def test_language_sample_counts_distinct_texts(spark):
    rng = random.Random(9)
    texts = [_lang(rng, "en", 30) for _ in range(12)]
    once = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    copied = spark.createDataFrame([("en", t) for t in texts for _ in range(50)], "lang string, text string")
    (_, want), (_, got) = language_id.fit_text_model(once, 8), language_id.fit_text_model(copied, 8)
    assert np.array_equal(got, want)  # eight texts, each once
    assert not np.array_equal(want, language_id.fit_text_model(once, 7)[1])


def _brute_rates(p, tokens, targets, rounds):
    """The same descent in plain numpy over documents."""
    total = tokens.sum()
    gram = (p * (tokens / total)[:, None]).T @ p
    gram += np.eye(4) * 1e-3 * np.trace(gram)
    r, last = np.ones(len(p)), np.full(4, np.inf)
    for _ in range(rounds):
        gap = (p * (tokens * r / total)[:, None]).sum(0) - targets
        if np.abs(gap).max() < 1e-5 or np.abs(gap - last).max() < 1e-4:
            break
        last = gap
        r = np.maximum(0, r - p @ np.linalg.solve(gram, gap))
    return r


def _scarce():
    """Cells of blurred posteriors over domains of which one is scarce."""
    shares = np.array([0.005, 0.0005, 0.9745, 0.02])
    tokens = shares.repeat(20) * np.random.default_rng(7).uniform(0.5, 1.5, 80) * 1e6
    return np.eye(4).repeat(20, axis=0) * 0.4 + 0.6 * shares, tokens


def test_mixing_fit_reaches_scarce_domains():
    p, tokens = _scarce()
    targets = np.array(mixing.TARGETS)
    prices, gap = mixing.fit_prices(p, tokens, mixing.TARGETS)
    r = np.clip(1 - p @ prices, 0, mixing.MOST_RATE)
    assert np.allclose((p * (tokens * r)[:, None]).sum(0) / tokens.sum(), targets, atol=1e-4) and np.abs(gap).max() < 1e-4
    old = (p * (tokens * _brute_rates(p, tokens, targets, 24))[:, None]).sum(0) / tokens.sum()
    assert abs(old[1] - targets[1]) > 1e-3  # the descent of few rounds doesn't
    bare = np.tile([0.5, 0.0, 0.5, 0.0], (3, 1))  # targets that no rates meet leave finite rates
    prices, gap = mixing.fit_prices(bare, np.ones(3), mixing.TARGETS)
    assert np.isfinite(prices).all() and abs(gap[1] + 0.01) < 1e-9


def test_mixing_matches_brute_force(spark):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(300):
        q, t = int(rng.random() < 0.7), int(rng.random() < 0.3)
        text = _prose(rng, rng.randint(20, 150))
        if not q:
            text = " | ".join(text.upper().split())
        if t:
            text += " grumble scoundrel"
        docs.append((i, text))
        labels.append((i, q, t))
    docs += [(1000, None), (1001, ""), (None, "null id"), (5, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("tokens", F.lit("x")).withColumn("rate", F.lit(2))
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    targets = (0.2, 0.1, 0.5, 0.2)
    rows = mixing.mixing_rates(df, lab, targets).collect()
    assert len(rows) == len(docs)
    p, tokens, r = np.array([x.posterior for x in rows]), np.array([x.tokens for x in rows], float), np.array([x.rate for x in rows])
    assert np.allclose(p.sum(1), 1) and (r >= 0).all()
    assert np.allclose(r, _brute_rates(p, tokens, np.array(targets), 24), atol=1e-5)
    assert np.allclose((p * (tokens * r)[:, None]).sum(0) / tokens.sum(), targets, atol=2e-3)
    truth = {i: 2 * q + t for i, q, t in labels}
    assert np.mean([x.posterior.index(max(x.posterior)) == truth[x.doc_id] for x in rows if x.doc_id in truth]) > 0.95
    mixed = mixing.mix(df, lab, targets)
    assert mixed.columns == df.columns
    n = {i.doc_id: i["count"] for i in mixed.groupBy("doc_id").count().collect()}
    for x in rows:
        rate = max(x.rate, 1.0) if x.posterior.index(max(x.posterior)) == 2 else x.rate
        assert int(rate) <= n.get(x.doc_id, 0) / (2 if x.doc_id == 5 else 1) <= int(rate) + 1
    assert mixing.mixing_rates(df.limit(0), lab).count() == 0
    assert mixing.mixing_rates(df.limit(3), lab.limit(0)).count() == 3


def test_mix_meets_shares_with_clean_documents_kept(spark):
    rng = random.Random(13)
    docs, truth = [], {}
    for i in range(400):
        q, t = int(i % 10 > 0), int(i % 8 == 0)
        text = _prose(rng, rng.randint(60, 100))
        docs.append((i, (text if q else " | ".join(text.upper().split())) + " grumble scoundrel" * t))
        truth[i] = 2 * q + t
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, d // 2, d % 2) for i, d in truth.items()], "doc_id long, quality int, toxic int")
    targets = np.array((0.2, 0.1, 0.5, 0.2))
    rows = mixing.mixing_rates(df, labels, tuple(targets), mixing.KEPT).collect()
    assert all(x.rate >= 1 for x in rows if int(np.argmax(x.posterior)) == 2)
    total = sum(np.array(x.posterior) * x.tokens * x.rate for x in rows)
    assert np.allclose(total / total.sum(), targets, atol=1e-3)
    share = np.zeros(4)
    for r in mixing.mix(df, labels, tuple(targets)).collect():
        share[truth[r.doc_id]] += len(r.text.split())
    assert np.abs(share / share.sum() - targets).max() < 0.05
