"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph (the text between line feeds) is hashed to a wide vector, and a
document's fingerprint is the sum of its paragraphs' vectors modulo 2^32 a lane.
Sums do not depend on the order of paragraphs, and a paragraph is inserted or
deleted by adding or subtracting its vector (`combine`).

A vector has two parts. EXACT lanes come from SHAKE-128 of the paragraph's
bytes and serve equality. LIKENESS lanes are a signed sketch of the paragraph's
shingles of three words; as the sketch is linear too, inner products of two
sums estimate how much the multisets of shingles share. No text of the 2 GB that a
row can hold has shingles enough to carry such a lane past its sign.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import parallelism
from .textkit import Words, gram_hashes, slices

EXACT, LIKENESS = 64, 256
SHINGLE = 3


def _paragraphs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each paragraph; an empty text has none."""
    feeds = np.flatnonzero(buf == 10)
    of = np.searchsorted(offs, feeds, side="right") - 1
    whole = np.flatnonzero(np.diff(offs) > 0)
    docs = np.concatenate([whole, of])
    starts = np.concatenate([offs[:-1][whole], feeds + 1])
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    last = np.ones(len(docs), dtype=bool)
    last[:-1] = docs[1:] != docs[:-1]
    ends = np.empty(len(docs), dtype=np.int64)
    ends[:-1] = starts[1:] - 1
    ends[last] = offs[docs[last] + 1]
    return starts, ends, docs


def fingerprint_lanes(column: pa.Array) -> np.ndarray:
    """Lanes (uint32) of every text of a string column; a null text counts as empty."""
    out = np.zeros((len(column), EXACT + LIKENESS), dtype=np.uint32)
    for a, b, buf, offs in slices(column):
        starts, ends, docs = _paragraphs(buf, offs)
        if not len(docs):
            continue
        raw = buf.tobytes()
        wide = b"".join(hashlib.shake_128(raw[s:e]).digest(4 * EXACT) for s, e in zip(starts.tolist(), ends.tolist(), strict=True))
        vectors = np.frombuffer(wide, dtype="<u4").reshape(-1, EXACT)
        firsts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        out[a + docs[firsts], :EXACT] = np.add.reduceat(vectors, firsts, axis=0, dtype=np.uint32)
        words = Words(buf, np.append(starts, len(buf)))
        grams, para = gram_hashes(words.hashes(), words.bounds, SHINGLE)
        lane = docs[para] * LIKENESS + (grams % np.uint64(LIKENESS)).astype(np.int64)
        sign = 1.0 - 2.0 * ((grams >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
        sums = np.bincount(lane, weights=sign, minlength=(b - a) * LIKENESS).astype(np.int64)
        out[a:b, EXACT:] = sums.reshape(b - a, LIKENESS).astype(np.uint32)
    return out


def encode_lanes(lanes: np.ndarray) -> list[str]:
    return [base64.b64encode(row.astype("<u4").tobytes()).decode() for row in lanes]


def decode_lanes(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u4").astype(np.uint32)


def combine(fingerprint: str, other: str, sign: int = 1) -> str:
    """The fingerprint after inserting (sign 1) or deleting (-1) the paragraphs of another."""
    a, b = decode_lanes(fingerprint), decode_lanes(other)
    return encode_lanes(((a + b) if sign >= 0 else (a - b))[None, :])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles of each pair of rows, 0 to 1; 1 for equal fingerprints."""
    x = a[:, EXACT:].view(np.int32).astype(np.float64)
    y = b[:, EXACT:].view(np.int32).astype(np.float64)
    both = (x * x).sum(1) + (y * y).sum(1)
    near = np.divide(2 * (x * y).sum(1), both, out=np.zeros(len(x)), where=both > 0)
    return np.where((a == b).all(1), 1.0, np.clip(near, 0.0, 1.0))


def fingerprint_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column fingerprint (string) of the whole text; null counts as empty, a column of that name is replaced."""
    docs = docs.drop("fingerprint")
    schema = docs.select("*", F.lit("").alias("fingerprint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes = fingerprint_lanes(batch.column(text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(encode_lanes(lanes), pa.string())], [*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(run, schema)


def with_successor(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows in runs of ascending id, each run followed by a copy of the row after it.

    Returns doc_id, text, h, run, extra; partitions hold whole runs, sorted. Only
    ids and hashes of texts are looked at to draw the runs; a run's copy of its
    successor is told by extra = 1. After the last row comes the first. Null ids
    come first; rows with equal ids stand in the order of the hashes of their
    texts, by which the rows of a null or often repeated id fall into several runs.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    n = 4 * parallelism(spark)
    found = Counter(int(c) for c in rows.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.002 if n < 400 else 0.0005))
    edges = F.array(*[F.lit(c) for c in sorted(found)]).cast("array<long>")
    range_ = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.size(F.filter(edges, lambda c: c <= F.col("doc_id"))))
    # an id that is an edge several times holds as many shares of the rows; its rows, and those without an id, are cut by hash
    parts = F.when(F.col("doc_id").isNull(), F.lit(n))
    if often := [(c, times + 1) for c, times in found.items() if times > 1]:
        parts = parts.otherwise(F.element_at(F.create_map(*[F.lit(x) for c, m in often for x in (c, m)]).cast("map<bigint,int>"), F.col("doc_id")))
    part = F.least(F.floor((F.col("h") / F.lit(2.0**64) + F.lit(0.5)) * parts), parts - 1)
    rows = rows.withColumn("run", (range_ * (n + 1) + F.coalesce(part, F.lit(n))).cast("long"))
    # a row per run: their number is set by the session's parallelism
    firsts = rows.groupBy("run").agg(F.min(F.struct("doc_id", "h")).alias("k")).orderBy("run").collect()
    starts = [(firsts[i - 1].run, firsts[i].k.doc_id, firsts[i].k.h) for i in range(len(firsts))]
    heads = spark.createDataFrame(starts or [(0, 0, 0)], "run long, doc_id long, h long").limit(len(starts))
    same = F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.h") == F.col("s.h"))
    copies = rows.drop("run").alias("r").join(F.broadcast(heads).alias("s"), same).select("r.doc_id", "r.text", "r.h", "s.run", F.lit(1).alias("extra"))
    # of a repeated row one copy is enough
    copies = copies.dropDuplicates(["run", "h"])
    both = rows.withColumn("extra", F.lit(0)).unionByName(copies)
    return both.repartition(parallelism(spark), "run").sortWithinPartitions("run", "extra", F.asc_nulls_first("doc_id"), "h", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how alike they are.

    The edited text has its last floor(n / 2) code points replaced by the first
    as many of the next document's text. Null texts count as empty; the likeness
    of two empty texts is 1. An empty table gives an empty result, a single
    document follows itself.
    """
    schema = "doc_id long, text string, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, texts, extra = (part.column(c).to_pylist() for c in ("doc_id", "text", "extra"))
                lanes = fingerprint_lanes(part.column("text"))
                if held is not None:
                    ids, texts, extra, lanes = [held[0], *ids], [held[1], *texts], [held[2], *extra], np.vstack([held[3], lanes])
                held = ids[-1], texts[-1], extra[-1], lanes[-1:]
                own = np.flatnonzero(np.array(extra[:-1]) == 0)
                if not len(own):
                    continue
                mine = [texts[i] for i in own]
                edited = [t[: len(t) - len(t) // 2] + texts[i + 1][: len(t) // 2] for i, t in zip(own, mine, strict=True)]
                other = fingerprint_lanes(pa.array(edited, pa.string()))
                a, b = lanes[own], lanes[own + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in own], pa.int64()), pa.array(mine, pa.string()), pa.array(edited, pa.string()), pa.array(encode_lanes(a)), pa.array(encode_lanes(other)), pa.array(likeness(a, other)), pa.array(likeness(a, b))], names
                )

    return with_successor(docs).mapInArrow(run, schema)
