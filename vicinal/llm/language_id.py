"""Language identification of web pages by Bayesian evidence fusion.

Log evidence for each language is added up from four sources: the page's text
(naive Bayes over hashed character trigrams, with a likelihood tempered for the
dependence of neighbouring trigrams), the language its markup declares, the
suffix of its address, and a prior for its host. Host priors come from grouped
aggregation: the text posteriors of all other pages of a host, smoothed towards
those of its registered domain, which are smoothed towards those of the whole
table. How far declarations and suffixes are trusted is learned the same way, from
how often they agree with pages whose text is clear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialise
from .textkit import slices

#: Hash buckets of character trigrams, and distinct labelled texts a language learns from at most.
BUCKETS, SAMPLE_ROWS = 1 << 14, 1500
#: Weight of one trigram's log likelihood, and the most that a text's evidence may weigh.
TEMPER, TEXT_CAP = 0.25, 12.0
#: Chance that a declared language, or a suffix that names one, is right, before any page is seen; pages that this counts for.
TRUST_DECLARED, TRUST_SUFFIX, TRUST_WEIGHT = 0.9, 0.7, 10.0
#: Least posterior of a text by itself for its page to teach that.
CLEAR = 0.9
#: Pages by which a host's prior is drawn towards its domain's, and that towards the table's.
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 20.0

# Labels under which two-letter suffixes register domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "ne", "net", "or", "org")
# Country suffixes of languages, by ISO 639-1 code.
SUFFIX_LANGUAGE = {
    "at": "de", "de": "de", "us": "en", "uk": "en", "au": "en", "nz": "en", "ie": "en", "es": "es", "mx": "es", "ar": "es", "co": "es",
    "cl": "es", "pe": "es", "fr": "fr", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "se": "sv", "jp": "ja", "cn": "zh",
}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = 0x20  # digits, punctuation and controls count as a gap
_FOLD[91:97] = 0x20
_FOLD[123:128] = 0x20


def _trigrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every byte trigram; runs of gaps count as one."""
    folded = _FOLD[buf]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    keep = np.ones(len(buf), bool)
    keep[1:] = (folded[1:] != 0x20) | (folded[:-1] != 0x20) | (row[1:] != row[:-1])
    x, row = folded[keep].astype(np.uint32), row[keep]
    code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) if len(x) > 2 else np.zeros(0, np.uint32)
    same = row[:-2] == row[2:] if len(x) > 2 else np.zeros(0, bool)
    bucket = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
    return (bucket % np.uint64(BUCKETS)).astype(np.int64)[same], (row[:-2] if len(x) > 2 else row[:0])[same]


def fit_text_model(docs: DataFrame, rows: int = SAMPLE_ROWS, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages, and log likelihood (language, bucket) of trigrams, from a bounded sample of labelled texts.

    The sample of a language are its distinct texts with the smallest hashes, one
    row each, however many copies a text has. Rows with a null language or text
    are left out.
    """
    good = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.lower(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # a cell is a range of hashes: the counts of 1024 of them a language tell where its smallest `rows` hashes end
    cell = F.shiftrightunsigned("h", 54)
    hashes = good.select("lang", F.xxhash64("text").alias("h")).distinct().withColumn("cell", cell)
    ends, seen = {}, {}
    for r in sorted(hashes.groupBy("lang", "cell").count().collect()):
        if seen.get(r.lang, 0) < rows:
            ends[r.lang] = (r.lang, r.cell, rows - seen.get(r.lang, 0))
            seen[r.lang] = seen.get(r.lang, 0) + r["count"]
    edge = good.sparkSession.createDataFrame(list(ends.values()), "lang string, last long, rest long")
    nth = F.row_number().over(Window.partitionBy("lang", "cell").orderBy("h"))
    chosen = hashes.join(F.broadcast(edge), "lang").where("cell <= last").withColumn("n", nth).where("cell < last OR n <= rest").select("lang", "h")
    copies = good.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h"], "left_semi")
    # equal hashes are equal texts but for a chance of 2^-64 a pair; the smallest is taken, so that order has no say
    sample = copies.groupBy("lang", "h").agg(F.min("text").alias("text"))

    def count(table: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS, np.int64)
        for _, _, buf, offs in slices(table.column("text").combine_chunks()):
            total += np.bincount(_trigrams(buf, offs)[0], minlength=BUCKETS)
        return pa.table({"lang": [table.column("lang")[0].as_py()], "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    got = sorted(sample.groupBy("lang").applyInArrow(count, "lang string, counts binary").collect(), key=lambda r: r.lang)
    if not got:
        return ["und"], np.zeros((1, BUCKETS))
    counts = np.stack([np.frombuffer(r.counts, "<i8") for r in got]).astype(np.float64) + 0.5
    return [r.lang for r in got], np.log(counts / counts.sum(axis=1, keepdims=True))


def page_text(html: Column) -> Column:
    """What a reader sees of a page: scripts, styles, comments and tags go."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"&[#\w]{1,10};", " ")


def _text_evidence(pages: DataFrame, model: np.ndarray) -> DataFrame:
    """pages with their text replaced by evidence, an array of log likelihoods less their largest."""
    centred = (model - model.max(axis=0)).astype(np.float32)
    keep = [c for c in pages.columns if c != "text"]
    schema = pages.select(*keep, F.array(F.lit(0.0)).alias("evidence")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(centred)))
            for a, b, buf, offs in slices(batch.column("text")):
                bucket, row = _trigrams(buf, offs)
                for k in range(len(centred)):
                    out[a:b, k] = np.bincount(row, weights=centred[k][bucket], minlength=b - a)
            out = np.maximum(TEMPER * (out - out.max(axis=1, keepdims=True)), -TEXT_CAP)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(centred)), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "evidence"])

    return pages.mapInArrow(run, schema)


def _normalised(logs: Column) -> Column:
    raised = F.transform(F.array(logs), lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v))))
    return F.element_at(F.transform(raised, lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y))), 1)


def identify(pages: DataFrame, docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """page_id, host, language, probability, declared, suffix, text_language of every page.

    docs: the labelled texts (lang, text). The languages are those of docs; a
    declared language or a suffix beyond them says nothing. Pages without text,
    host or declaration are judged by what there is, ties go to the first
    language in alphabetical order; repeated rows are judged alike and count
    each for their host's prior, in which a page's own text has no part. Texts
    are taken whole, a run of pages at a time. An empty table gives an empty
    result.
    """
    langs, model = fit_text_model(docs, sample_rows)
    k = len(langs)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), declared.alias("declared"), page_text(F.col("html")).alias("text"))
    rows = materialise(_text_evidence(rows, model), "language-evidence")
    second = "|".join(SECOND_LEVEL)
    rows = rows.withColumn("domain", F.regexp_extract("host", rf"((?:[^.]+\.(?:{second})\.[a-z]{{2}}|[^.]+\.[^.]+))$", 1))
    suffix = F.regexp_extract("host", r"\.([a-z]{2})$", 1)
    meant = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    rows = rows.withColumn("suffix", F.coalesce(F.element_at(meant, suffix), F.lit(""))).withColumn("own", _normalised(F.col("evidence")))
    # sums over pages are taken by host first; domains and the table are sums of those
    named = lambda said: F.element_at("own", F.array_position(F.array(*[F.lit(x) for x in langs]), said).cast("int"))
    taught = lambda said: (F.array_max("own") >= CLEAR) & said.isin(*langs)
    agree = lambda c: [F.sum(F.when(taught(F.col(c)), named(F.col(c))).otherwise(0.0)).alias(f"{c}_right"), F.sum(F.when(taught(F.col(c)), 1).otherwise(0)).alias(f"{c}_n")]
    hosts = rows.groupBy("host", "domain").agg(F.count("*").alias("n"), *[F.sum(F.element_at("own", i + 1)).alias(f"s{i}") for i in range(k)], *agree("declared"), *agree("suffix"))
    hosts = materialise(hosts, "language-hosts")
    domains = materialise(hosts.groupBy("domain").agg(F.sum("n").alias("dn"), *[F.sum(f"s{i}").alias(f"d{i}") for i in range(k)]), "language-domains")
    said = [f"{c}_{x}" for c in ("declared", "suffix") for x in ("right", "n")]
    whole = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"t{i}") for i in range(k)], *[F.sum(c).alias(c) for c in said]).first()
    base = [((whole[f"t{i}"] or 0.0) + 1.0) / ((whole.n or 0) + k) for i in range(k)]
    trust = {c: ((whole[f"{c}_right"] or 0.0) + first * TRUST_WEIGHT) / ((whole[f"{c}_n"] or 0) + TRUST_WEIGHT) for c, first in (("declared", TRUST_DECLARED), ("suffix", TRUST_SUFFIX))}
    priors = materialise(hosts.join(domains, "domain").select("host", "n", "dn", *[f"{x}{i}" for x in "sd" for i in range(k)]), "language-priors")
    joined = rows.join(priors, "host")
    mine = lambda i: F.element_at("own", i + 1)
    of_domain = lambda i: (F.col(f"d{i}") - mine(i) + DOMAIN_WEIGHT * base[i]) / (F.col("dn") - 1 + DOMAIN_WEIGHT)
    prior = F.array(*[F.log(F.greatest((F.col(f"s{i}") - mine(i) + HOST_WEIGHT * of_domain(i)) / (F.col("n") - 1 + HOST_WEIGHT), F.lit(1e-9))) for i in range(k)])
    told = lambda c: F.array(*[F.when(~F.col(c).isin(*langs), 0.0).when(F.col(c) == x, float(np.log(trust[c]))).otherwise(float(np.log(max(1 - trust[c], 1e-6) / max(k - 1, 1)))) for x in langs])
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add(F.col("evidence"), prior), add(told("declared"), told("suffix")))
    names = F.array(*[F.lit(x) for x in langs])
    pick = lambda v: F.element_at(names, F.array_position(v, F.array_max(v)).cast("int"))
    return joined.withColumn("posterior", _normalised(logs)).select(
        "page_id", "host", pick(F.col("posterior")).alias("language"), F.array_max("posterior").alias("probability"), "declared", "suffix", pick(F.col("evidence")).alias("text_language")
    )
