"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut to overlapping chunks that cover all of it. In each
chunk learned filters slide over embedded bytes, every filter is max-pooled, and
a small dense layer gives the chunk's evidence; the document's probability
combines the evidence of all its chunks. Filters start at every STRIDE-th byte.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import slices

CHUNK, STEP = 512, 384
#: Bytes between filter positions, and blocks of STRIDE bytes that a filter spans.
STRIDE, SPAN = 4, 3
EMBED, FILTERS, HIDDEN = 8, 64, 32
#: Chunks of one pass through the network.
PASS = 128


def chunk_counts(offs: np.ndarray) -> np.ndarray:
    """Chunks of each row; an empty text has one."""
    return np.maximum(1, -(-(np.diff(offs) - (CHUNK - STEP)) // STEP))


def chunk_matrix(buf: np.ndarray, offs: np.ndarray, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Chunks low to high (all: None) of all rows (uint8, zero-padded) and the row of each."""
    ends = np.cumsum(chunk_counts(offs))
    nth = np.arange(low, int(ends[-1]) if high is None else min(high, int(ends[-1]))) if len(ends) else np.zeros(0, int)
    row = np.searchsorted(ends, nth, side="right")
    start = offs[:-1][row] + (nth - np.append(0, ends)[row]) * STEP
    at = start[:, None] + np.arange(CHUNK)
    inside = at < offs[1:][row][:, None]
    padded = np.append(buf, np.uint8(0))
    return np.where(inside, padded[np.minimum(at, len(buf))], np.uint8(0)), row


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        width = STRIDE * EMBED
        return cls({
            "embed": draw(256, EMBED, scale=0.5), "conv": draw(SPAN * width, FILTERS, scale=(SPAN * width) ** -0.5), "conv_b": np.zeros(FILTERS, np.float32),
            "dense": draw(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5), "dense_b": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN, 1, scale=HIDDEN**-0.5), "out_b": np.zeros(1, np.float32),
        })

    def pooled(self, chunks: np.ndarray, places: bool = False):
        """Max-pooled filters of each chunk and, if asked for, the position of each maximum."""
        n = len(chunks)
        blocks = self.p["embed"][chunks].reshape(n, CHUNK // STRIDE, STRIDE * EMBED)
        last = CHUNK // STRIDE - SPAN + 1
        width = STRIDE * EMBED
        y = sum(blocks[:, i : i + last] @ self.p["conv"][i * width : (i + 1) * width] for i in range(SPAN))
        if not places:
            return np.maximum(y.max(axis=1) + self.p["conv_b"], 0), None
        best = y.argmax(axis=1)
        top = np.take_along_axis(y, best[:, None], axis=1)[:, 0] + self.p["conv_b"]
        return np.maximum(top, 0), best

    def evidence(self, chunks: np.ndarray) -> np.ndarray:
        out = np.empty(len(chunks), np.float32)
        for i in range(0, len(chunks), PASS):
            h, _ = self.pooled(chunks[i : i + PASS])
            out[i : i + PASS] = (np.maximum(h @ self.p["dense"] + self.p["dense_b"], 0) @ self.p["out"] + self.p["out_b"])[:, 0]
        return out

    def gradients(self, chunks: np.ndarray, row: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted log loss of the rows and its gradient."""
        p, n = self.p, len(labels)
        h, best = self.pooled(chunks, places=True)
        a = np.maximum(h @ p["dense"] + p["dense_b"], 0)
        share = 1.0 / np.bincount(row, minlength=n).astype(np.float32)
        z = np.bincount(row, weights=(a @ p["out"] + p["out_b"])[:, 0] * share[row], minlength=n)
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = -np.average(np.where(labels == 1, np.log(q + 1e-9), np.log(1 - q + 1e-9)), weights=weights)
        dz = ((q - labels) * weights / weights.sum()).astype(np.float32)
        de = (dz * share)[row][:, None]
        g = {"out": a.T @ de, "out_b": de.sum(0)}
        da = (de @ p["out"].T) * (a > 0)
        g |= {"dense": h.T @ da, "dense_b": da.sum(0)}
        dh = (da @ p["dense"].T) * (h > 0)
        g["conv_b"] = dh.sum(0)
        reach = SPAN * STRIDE
        at = best[:, :, None] * STRIDE + np.arange(reach)
        seen = np.take_along_axis(chunks[:, None, :], at, axis=2)
        x = p["embed"][seen].reshape(len(chunks), FILTERS, reach * EMBED)
        g["conv"] = np.einsum("cf,cfx->xf", dh, x)
        dx = (dh[:, :, None] * p["conv"].T[None]).reshape(-1, EMBED)
        flat = seen.reshape(-1)
        g["embed"] = np.stack([np.bincount(flat, weights=dx[:, j], minlength=256) for j in range(EMBED)], axis=1).astype(np.float32)
        return float(loss), g


def train(chunks_of: list[np.ndarray], labels: list[int], epochs: int = 6, seed: int = 11, rate: float = 3e-3, chunks_per_text: int = 6, batch: int = 64, zero_weight: float = 2.5) -> Network:
    """Adam on the log loss, label 0 weighted by zero_weight; each epoch sees up to chunks_per_text random chunks of a text.

    chunks_of: the chunks of each text. Without texts of both labels the network
    stays as drawn, but gives the one label's rate as its score.
    """
    net = Network.fresh(seed)
    y_all = np.asarray(labels, np.float32)
    if not len(y_all) or y_all.min() == y_all.max():
        net.p["out"][:] = 0
        net.p["out_b"][:] = 0 if not len(y_all) else 4.0 if y_all[0] else -4.0
        return net
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    chunks = np.concatenate(chunks_of)
    bounds = np.append(0, np.cumsum([len(c) for c in chunks_of]))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step, total = 0, epochs * (-(-len(labels) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), batch):
            mine = order[i : i + batch]
            picks = [np.arange(bounds[d], bounds[d + 1]) if bounds[d + 1] - bounds[d] <= chunks_per_text else bounds[d] + rng.choice(bounds[d + 1] - bounds[d], chunks_per_text, replace=False) for d in mine]
            _, g = net.gradients(chunks[np.concatenate(picks)], np.repeat(np.arange(len(mine)), [len(x) for x in picks]), y_all[mine], np.where(y_all[mine] == 1, 1, zero_weight).astype(np.float32))
            step += 1
            lr = rate * (1 - 0.9 * step / total)
            for k, x in net.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                x -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)
    return net


def score_column(net: Network, column: pa.Array) -> np.ndarray:
    """Probability of label 1 of every text of a string column; null counts as empty. Chunks are made a few at a time."""
    out = np.empty(len(column))
    for a, b, buf, offs in slices(column, 1 << 18):
        counts, z = chunk_counts(offs), np.zeros(b - a)
        for low in range(0, int(counts.sum()), 8 * PASS):
            chunks, row = chunk_matrix(buf, offs, low, low + 8 * PASS)
            z += np.bincount(row, weights=net.evidence(chunks), minlength=b - a)
        out[a:b] = 1 / (1 + np.exp(-np.clip(z / counts, -30, 30)))
    return out


#: Labelled rows that the network learns from at most, and chunks of each, spread evenly over its text: 100 MB in all.
SAMPLE_ROWS, SAMPLE_CHUNKS = 4000, 48


def training_sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[np.ndarray], list[int]]:
    """Chunks and labels of up to `rows` labelled documents, those with the smallest hashes of their ids.

    Ids whose crc32 (as text) is a multiple of 5 are held out. Labels that are
    null or not 0 or 1, and ids labelled both ways, are left out; of several
    documents with one id one is taken. Of a text of more than SAMPLE_CHUNKS
    chunks so many come to the driver, from its start to its end.
    """
    learnt = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    clear = learnt.groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
    chosen = clear.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", F.col("lo").alias("y"))
    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    picked = picked.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").cast("int").alias("y"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, buf, offs in slices(batch.column("text"), 1 << 18):
                for i in range(len(offs) - 1):
                    own = buf[offs[i] : offs[i + 1]]
                    n = int(chunk_counts(np.array([0, len(own)]))[0])
                    takes = np.unique(np.linspace(0, n - 1, min(n, SAMPLE_CHUNKS)).astype(int))
                    made = np.concatenate([chunk_matrix(own, np.array([0, len(own)]), int(t), int(t) + 1)[0] for t in takes])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a + i, 1), batch.column("y").slice(a + i, 1), pa.array([made.tobytes()], pa.binary())], ["doc_id", "y", "chunks"])

    schema = picked.select("doc_id", "y", F.lit(b"").alias("chunks")).schema
    got = sorted((r.doc_id, bytes(r.chunks), r.y) for r in picked.mapInArrow(cut, schema).collect())
    return [np.frombuffer(c, np.uint8).reshape(-1, CHUNK) for _, c, _ in got], [y for _, _, y in got]


def score_documents(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs with a column score, the network's probability of label 1; a column of that name is replaced."""
    docs = docs.drop("score")
    weights = pickle.dumps(net.p)
    schema = docs.select("*", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Network(pickle.loads(weights))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_column(mine, batch.column(text_col)))], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with a column score, by a network fitted on a bounded sample of labels.

    Whole texts alone are scored; null and empty texts get the score of one
    empty chunk. Repeated rows are scored each; an empty table stays empty.
    """
    return score_documents(docs, train(*training_sample(docs, labels, rows)))
