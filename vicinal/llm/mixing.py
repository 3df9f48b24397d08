"""Mixing documents to target weights of domains, with soft membership.

A naive Bayes classifier, fitted by grouped counts on a labelled table, gives
each document's posterior over domains. Projected gradient ascent on the dual of a
weighted least-squares problem then finds the document rates nearest to 1, within
their bounds, whose expected token totals by domain match the targets. Documents
with equal features have equal posteriors and so equal rates: the sums of an
iteration run over the feature cells, whose number is bounded by the features'
ranges.

Everything that touches documents is built-in DataFrame functions; the driver
sees counts and cells whose number the parameters bound.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialise

#: Domains: quality and toxicity of the labelled table.
DOMAINS = ("low_clean", "low_toxic", "high_clean", "high_toxic")
#: The domain that `mix` never thins.
KEPT = "high_clean"
#: Share of tokens that each domain is to have.
TARGETS = (0.04, 0.01, 0.91, 0.04)
#: Labelled rows from which marker words are learned at most, and the words kept.
SAMPLE_ROWS, MARKERS = 5000, 40
#: Bounds of a rate, and the weight of a residual's price against that of leaving rates at 1.
LEAST_RATE, MOST_RATE, SLACK = 0.0, 1000.0, 1e-7
#: Features and their numbers of values.
FEATURES = {"f_marker": 4, "f_repeat": 5, "f_symbol": 5, "f_upper": 4, "f_size": 4}


def _bucket(x: Column, edges: tuple[float, ...]) -> Column:
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(x < F.lit(edges[i]), i).otherwise(out)
    return out.cast("int")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def _label(labels: DataFrame) -> DataFrame:
    """doc_id, domain index; ids with a null or another label, or with two different ones, are left out."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1))
    one = good.groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("a"), F.max(F.struct("quality", "toxic")).alias("b")).where("a = b")
    return one.select("doc_id", (2 * F.col("a.quality") + F.col("a.toxic")).cast("int").alias("domain"))


def marker_words(docs: DataFrame, labelled: DataFrame, rows: int = SAMPLE_ROWS, keep: int = MARKERS) -> list[str]:
    """Words that tell toxic documents best, from a bounded sample of labelled rows."""
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    seen = docs.join(F.broadcast(sample), "doc_id").select((F.col("domain") % 2).alias("toxic"), F.explode(F.array_distinct(_words(F.col("text")))).alias("w"))
    words = seen.groupBy(F.regexp_replace("w", r"[^\p{L}\p{N}]+", "").alias("w")).agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    odds = (F.col("t") + 0.1) / (F.col("n") - F.col("t") + 1.0)
    return [r.w for r in words.where("length(w) > 2 AND t >= 5").withColumn("odds", odds * F.sqrt("t")).where("t > n - t").orderBy(F.desc("odds"), "w").limit(keep).collect()]


def features(docs: DataFrame, markers: list[str], *carried: str) -> DataFrame:
    """doc_id, tokens and the feature buckets of every whole text, and carried columns; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    share = lambda others: F.char_length(F.regexp_replace("t", others, "")) / F.greatest(F.char_length("t"), F.lit(1))
    split = docs.select("doc_id", *carried, text.alias("t"), _words(text).alias("w"))
    bare = F.split(F.lower("t"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    hits = F.size(F.array_intersect(bare, F.array(*[F.lit(m) for m in markers]))) if markers else F.lit(0)
    # measured in a projection of their own, as a bucket names its measure once an edge
    measured = split.select(
        "doc_id", *carried, F.size("w").cast("long").alias("tokens"), F.size(F.array_distinct("w")).alias("_distinct"), hits.alias("_hits"),
        share(r"[^|#$%&*!~\^{}<>=@]+").alias("_symbol"), share("[^A-Z]+").alias("_upper"),
    )
    return measured.select(
        "doc_id", *carried, "tokens", F.least("_hits", F.lit(3)).alias("f_marker"),
        _bucket(F.col("_distinct") / F.greatest("tokens", F.lit(1)), (0.2, 0.35, 0.5, 0.7)).alias("f_repeat"),
        _bucket(F.col("_symbol"), (1e-9, 0.01, 0.03, 0.1)).alias("f_symbol"),
        _bucket(F.col("_upper"), (0.03, 0.1, 0.5)).alias("f_upper"),
        _bucket(F.col("tokens"), (20, 100, 1000)).alias("f_size"),
    )


def _log_tables(rows: DataFrame, labelled: DataFrame) -> tuple[list[float], dict[str, list[list[float]]]]:
    """Smoothed log priors of the domains and log likelihoods of each feature's values."""
    k = len(DOMAINS)
    known = rows.join(labelled, "doc_id")
    flat = known.select("domain", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])).alias("x"))
    counts = {(r.domain, r.feature, r.value): r["count"] for r in flat.groupBy("domain", "x.feature", "x.value").count().collect()}
    first = next(iter(FEATURES))
    totals = [sum(counts.get((d, first, v), 0) for v in range(FEATURES[first])) for d in range(k)]
    priors = [math.log((n + 1) / (sum(totals) + k)) for n in totals]
    tables = {f: [[math.log((counts.get((d, f, v), 0) + 0.5) / (totals[d] + 0.5 * size)) for d in range(k)] for v in range(size)] for f, size in FEATURES.items()}
    return priors, tables


def posteriors(priors: list[float], tables: dict[str, list[list[float]]]) -> Column:
    """Array of the domains' posteriors of a row with the feature columns."""
    add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    logs = F.array(*[F.lit(x) for x in priors])
    for f, table in tables.items():
        logs = add(logs, F.element_at(F.array(*[F.array(*[F.lit(x) for x in row]) for row in table]), F.col(f) + 1))
    # a transform over one element names what is used twice
    raised = F.transform(F.array(logs), lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v))))
    return F.element_at(F.transform(raised, lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y))), 1)


def rate(posterior: Column, prices: np.ndarray, base: float = 1.0, least: Column | None = None) -> Column:
    """The rate at the given prices of the domains' tokens, from base, within its bounds."""
    cost = F.aggregate(F.zip_with(posterior, F.array(*[F.lit(float(x)) for x in prices]), lambda p, y: p * y), F.lit(0.0), lambda a, x: a + x)
    return F.least(F.lit(MOST_RATE), F.greatest(F.lit(LEAST_RATE) if least is None else least, F.lit(base) - cost))


def fit_prices(p: np.ndarray, tokens: np.ndarray, targets: tuple[float, ...], least: np.ndarray | float = LEAST_RATE, rounds: int = 500, close: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Prices of the domains and the residuals that they leave, by projected gradient over cells (p: posterior, tokens).

    A cell's rate is 1 less the price of its posterior, projected to the bounds,
    of which least (one a cell, or one for all) is the lower.
    The dual's gradient are the residuals (share of tokens less target), less
    SLACK times the prices: what no rates in the bounds can meet stays a residual,
    and so does a domain that is next to absent. A step is weighted by the
    inverse Gram matrix of the cells inside the bounds, with a ridge that falls
    where progress is slow, and halved until the dual rises by enough. Ends where
    the gradient is within `close` of 0, that is where the dual is largest.
    """
    k, total = len(targets), float(tokens.sum())
    prices = np.zeros(k)
    if not total:
        return prices, np.zeros(k)
    w, t = tokens / total, np.array(targets)

    def at(y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        free = 1 - p @ y
        r = np.clip(free, least, MOST_RATE)
        gap = (w * r) @ p - t
        return float(w @ (0.5 * (r - 1) ** 2 + (p @ y) * r) - y @ t - SLACK / 2 * y @ y), gap, free == r

    value, gap, inside = at(prices)
    scale, ridge = float(np.trace((p * w[:, None]).T @ p)), 1e-3
    for _ in range(rounds):
        up = gap - SLACK * prices
        if np.abs(up).max() < close:
            break
        held = p[inside]
        step = np.linalg.solve((held * w[inside, None]).T @ held + (ridge * scale + SLACK) * np.eye(k), up)
        size = 1.0
        while (new := at(prices + size * step))[0] < value + 1e-4 * size * float(up @ step) and size > 1e-12:
            size /= 2
        before = np.abs(up).max()
        prices = prices + size * step
        value, gap, inside = new
        if np.abs(gap - SLACK * prices).max() > before / 4:
            ridge = max(ridge / 10, 1e-12)
    return prices, gap


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS, kept: str | None = None) -> DataFrame:
    """doc_id, tokens, posterior (array by DOMAINS) and rate of every document.

    Rates are expected numbers of copies, MOST_RATE at most; the corpus keeps its
    size in tokens, and each domain's expected share of them is its target, as
    far as rates in their bounds can meet it; what is left is logged. Rows that are
    likeliest of the domain kept have a rate of 1 at least, within the fit; if
    that can't be met at the corpus's size, its size is free and the shares are
    those of what it becomes. Null and empty texts have no tokens and a rate like any other text of their features;
    repeated rows have equal rates. Without usable labels all rates follow from
    equal posteriors. Further columns are left alone; an empty table gives an
    empty result.
    """
    rows, posterior, priced = _fitted(docs.select("doc_id", "text"), labels, targets, kept)
    return rows.withColumn("posterior", posterior).select("doc_id", "tokens", "posterior", priced.alias("rate"))


def _fitted(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...], kept: str | None, *carried: str) -> tuple[DataFrame, Column, Column]:
    """Rows with doc_id, the carried columns, tokens and features; their posterior, and their rate over a column posterior."""
    labelled = materialise(_label(labels), "mixing-labels")
    rows = materialise(features(docs, marker_words(docs, labelled), *carried), "mixing-features")
    posterior = posteriors(*_log_tables(rows, labelled))
    cells = rows.groupBy(*FEATURES).agg(F.sum("tokens").alias("tokens")).withColumn("p", posterior).select("p", "tokens").collect()
    p, tokens = np.array([c.p for c in cells]).reshape(-1, len(targets)), np.array([c.tokens for c in cells], float)
    least, floor, base = LEAST_RATE, None, 1.0
    if kept is not None:
        least = np.where(p.argmax(axis=1) == DOMAINS.index(kept), 1.0, LEAST_RATE)
        floor = F.when(F.array_position("posterior", F.array_max("posterior")) == DOMAINS.index(kept) + 1, 1.0).otherwise(LEAST_RATE)
    prices, gap = fit_prices(p, tokens, targets, least)
    if kept is not None and np.abs(gap).max() > 1e-4:  # tokens of a domain less its share of all tokens are to be 0
        prices, gap = fit_prices(p - np.array(targets), tokens, (0.0,) * len(targets), least)
        base = 1.0 + float(prices @ np.array(targets))
        gap /= float(tokens @ np.clip(base - p @ prices, least, MOST_RATE)) / tokens.sum()
    if np.abs(gap).max() > 1e-3:
        logging.getLogger(__name__).warning("shares less targets left by the mix: %s", dict(zip(DOMAINS, np.round(gap, 5).tolist(), strict=True)))
    return rows, posterior, rate(F.col("posterior"), prices, base, floor)


def mix(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """docs with each row as often as its rate says: the whole part of it, and once more for
    the share of ids whose hash is below the rest. A row that is likeliest of the domain
    KEPT stays at least once, so that no mix thins clean documents; the other rates make
    up for that. A row's rate follows from its own features: rows are neither joined nor
    shuffled. Columns are those of docs."""
    own = [f"_own{i}" for i in range(len(docs.columns))]
    wide = docs.select("doc_id", "text", *[F.col(c).alias(o) for c, o in zip(docs.columns, own, strict=True) if c not in ("doc_id", "text")])
    carried = [c for c in wide.columns if c != "doc_id"]
    rows, posterior, priced = _fitted(wide, labels, targets, KEPT, *carried)
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    rated = rows.withColumn("posterior", posterior).withColumn("rate", priced).withColumn("n", copies.cast("int")).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return rated.select(*[F.col(c if c in ("doc_id", "text") else o).alias(c) for c, o in zip(docs.columns, own, strict=True)])
