"""Substring deduplication: windows of words that start at more than one place.

Every window of `window` consecutive words has a minimiser, the smallest hash
among the runs of MINIMISER words in it. Consecutive windows with the same
minimiser form a super-k-mer, and its words travel as one packed string to the
bucket of that minimiser; equal windows have equal minimisers, so that they meet
in one bucket, where sorting counts them exactly.

A task counts the windows of its own slice of documents first. It sends one
representative of each distinct window, told whether the slice has it again, so
that what a bucket receives of one window is bounded by the number of slices,
however often a passage occurs.

Windows are sorted by a 64-bit hash; those of equal hashes are then compared
word by word, so that no two different windows are ever taken for one. Runs of
MINIMISER words that are very frequent stand last in the order of minimisers, so
that the windows that hold a common phrase are dealt by their other words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import estimated_bytes, fresh, materialise, parallelism, remove
from .textkit import Words, buffer_of, mix64, run_hashes, slices

#: Words of a minimiser.
MINIMISER = 3
#: Bytes of text whose windows a task counts at once.
SLICE = 2 << 20
#: Bytes of text for which there is a bucket, beyond a few a task, and times that a run occurs in a slice to be counted.
BUCKET_BYTES, COMMON = 32 << 20, 16


def _heads(words: Words, window: int) -> np.ndarray:
    """First word of every window."""
    heads = np.arange(len(words.starts))
    return heads[heads + window <= np.repeat(words.bounds[1:], np.diff(words.bounds))]


def _minimisers(word_hashes: np.ndarray, heads: np.ndarray, window: int, frequent: np.ndarray) -> np.ndarray:
    """The smallest hash of MINIMISER consecutive words inside each window; the frequent ones (sorted) come last."""
    m = min(MINIMISER, window)
    if not len(heads):
        return np.zeros(0, np.uint64)
    low = run_hashes(word_hashes, m)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, low), len(frequent) - 1)
        low = (low >> np.uint64(1)) | ((frequent[at] == low).astype(np.uint64) << np.uint64(63))
    width = window - m + 1
    done = 1
    while done < width:  # doubling: after each step low covers `done` positions
        step = min(done, width - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    return low[heads]


def _groups(hashes: np.ndarray, words: Words, raw: bytes, heads: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the windows, the start of each run of equals in it, and the runs' lengths.

    Neighbours of equal hashes are compared by their words, a whole run of
    consecutive windows at once; if any differ, the windows of that hash are told
    apart by their words.
    """
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    tied = np.flatnonzero(~new)
    if len(tied):
        by = np.argsort(order[tied - 1], kind="stable")
        x, y = heads[order[tied - 1]][by], heads[order[tied]][by]
        cut = np.flatnonzero(np.r_[True, (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1), True])
        content = lambda i, j: raw[words.starts[i] : words.ends[j + window - 1]].split()
        wrong = [h[tied[by[s:e]]] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if content(x[s], x[e - 1]) != content(y[s], y[e - 1])]
        if wrong:
            known: dict[tuple, int] = {}
            rank = np.zeros(len(hashes), np.int64)
            for i in np.flatnonzero(np.isin(hashes, np.concatenate(wrong))).tolist():
                j = heads[i]
                key = tuple(raw[s:e] for s, e in zip(words.starts[j : j + window].tolist(), words.ends[j : j + window].tolist(), strict=True))
                rank[i] = known.setdefault(key, len(known) + 1)
            order = np.lexsort((rank, hashes))
            h, r = hashes[order], rank[order]
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    starts = np.flatnonzero(new)
    return order, starts, np.diff(np.append(starts, len(h)))


def frequent_runs(docs: DataFrame, window: int, text_col: str, n_buckets: int) -> np.ndarray:
    """Hashes of the runs of MINIMISER words that make up more than 1 / (16 n_buckets) of all runs.

    A task counts the runs of a slice and tells those that occur COMMON times in
    it at least; there are 16 n_buckets of them at most. The list only balances
    buckets, results don't depend on it.
    """
    m = min(MINIMISER, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offs in slices(batch.column(text_col), SLICE):
                found, n = np.unique(run_hashes(Words(buf, offs).hashes(), m), return_counts=True)
                common = n >= COMMON
                runs = np.append(found[common].view(np.int64), 0)
                counts, total = np.append(n[common], 0), np.append(np.zeros(int(common.sum()), np.int64), n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array(counts), pa.array(total)], ["run", "n", "total"])

    counted = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).mapInArrow(run, "run long, n long, total long").groupBy("run").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    counted = materialise(counted, "runs")
    total = counted.agg(F.sum("total")).first()[0] or 0
    rows = counted.where(F.col("n") * (16 * n_buckets) > F.lit(total)).select("run").collect()
    remove(counted)
    return np.sort(np.array([r.run for r in rows], np.int64).view(np.uint64))


def _ranges(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive ascending numbers."""
    new = np.ones(len(heads), bool)
    new[1:] = heads[1:] != heads[:-1] + 1
    starts = np.flatnonzero(new)
    return heads[starts], heads[np.append(starts[1:], len(heads)) - 1] if len(heads) else heads


def repeated_windows(docs: DataFrame, window: int, key_cols: tuple[str, ...], text_col: str) -> DataFrame:
    """key columns, spans: windows of each document that start anywhere else too.

    spans: packed int64 pairs, the first and last window (by its first word) of
    a run of repeated windows. A document can have several rows.
    """
    n_buckets = max(6 * parallelism(docs.sparkSession), math.ceil(estimated_bytes(docs) / BUCKET_BYTES))
    frequent = frequent_runs(docs, window, text_col, n_buckets)
    key_fields = ", ".join(f"{k} {t}" for k, t in docs.select(*key_cols).dtypes)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        names = ["bucket", "load", *key_cols, "spans"]

        for batch in batches:
            keys = batch.select(list(key_cols))
            for a, b, buf, offs in slices(batch.column(text_col), SLICE):
                words = Words(buf, offs)
                heads = _heads(words, window)
                if not len(heads):
                    continue
                raw, hashes = buf.tobytes(), words.hashes()
                order, starts, counts = _groups(run_hashes(hashes, window)[heads], words, raw, heads, window)
                again = np.zeros(len(heads), bool)
                again[order] = np.repeat(counts > 1, counts)
                doc = np.searchsorted(words.bounds, heads, side="right") - 1
                spans, at = _spans(heads[again], doc[again], words.bounds)
                if len(at):
                    rows = keys.take(pa.array(a + at))
                    via = pa.array(((a + at) % n_buckets).astype(np.int32))  # through any bucket, so that one pass over the texts is enough
                    yield pa.RecordBatch.from_arrays([via, pa.nulls(len(at), pa.binary()), *rows.columns, pa.array(spans, pa.binary())], names)
                chosen = np.sort(order[starts])
                low = _minimisers(hashes, heads[chosen], window, frequent)
                bucket = (mix64(low) % np.uint64(n_buckets)).astype(np.int64)
                h = heads[chosen]
                cut = np.ones(len(h), bool)  # a super-k-mer: consecutive windows, one minimiser, one document
                cut[1:] = (h[1:] != h[:-1] + 1) | (low[1:] != low[:-1]) | (again[chosen][1:] != again[chosen][:-1])
                head = np.flatnonzero(cut)
                tail = np.append(head[1:], len(h)) - 1
                text_from, text_to = words.starts[h[head]], words.ends[h[tail] + window - 1]
                meta = np.stack([doc[chosen][head], h[head] - words.bounds[doc[chosen][head]], again[chosen][head]], axis=1).astype("<i8")
                into = np.argsort(bucket[head], kind="stable")
                edges = np.searchsorted(bucket[head][into], np.arange(n_buckets + 1))
                loads, ids = [], []
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    mine = into[edges[k] : edges[k + 1]]
                    strings = [raw[s:e] for s, e in zip(text_from[mine].tolist(), text_to[mine].tolist(), strict=True)]
                    local, back = np.unique(meta[mine, 0], return_inverse=True)
                    info = meta[mine].copy()
                    info[:, 0] = back.reshape(-1)
                    owners = pa.RecordBatch.from_arrays(keys.take(pa.array(a + local)).columns, list(key_cols))
                    loads.append(pack.compress(_frame(strings, info, owners)))
                    ids.append(k)
                used = [pa.nulls(len(ids), c.type) for c in keys.columns]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(loads, pa.binary()), *used, pa.nulls(len(ids), pa.binary())], names)

    def count(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        told = table.filter(table.column("load").is_null()).select([*key_cols, "spans"])
        table = table.filter(table.column("load").is_valid())
        if not table.num_rows:
            return told
        of, place, known, texts, owners, base = [], [], [], [], [], 0
        for load in table.column("load"):
            strings, info, own = _unframe(unpack.decompress(load.as_py()))
            info[:, 0] += base
            texts.append(strings)
            of.append(info)
            owners.append(own)
            base += own.num_rows
        info = np.concatenate(of)
        buf, offs = buffer_of(pa.chunked_array(texts).cast(pa.large_binary()))
        del texts, table
        words = Words(buf, offs)
        heads = _heads(words, window)
        order, starts, counts = _groups(run_hashes(words.hashes(), window)[heads], words, buf.tobytes(), heads, window)
        kmer = np.searchsorted(words.bounds, heads, side="right") - 1
        of, known = info[kmer, 0].astype(np.int32), info[kmer, 2] != 0
        place = (info[kmer, 1] + heads - words.bounds[kmer]).astype(np.int32)
        hit = order[np.repeat(counts, counts) > 1]
        hit = hit[~known[hit]]
        hit = hit[np.lexsort((place[hit], of[hit]))]
        width = int(place.max(initial=0)) + 2
        lows, highs = _ranges(of[hit].astype(np.int64) * width + place[hit])
        spans, rows = _packed(lows % width, highs % width, lows // width)
        all_owners = pa.Table.from_batches(owners).combine_chunks()
        found = pa.table([*all_owners.take(pa.array(rows)).columns, pa.array(spans, pa.binary())], names=[*key_cols, "spans"])
        return pa.concat_tables([told.cast(found.schema), found])

    sent = docs.select(*key_cols, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).mapInArrow(send, f"bucket int, load binary, {key_fields}, spans binary")
    return sent.groupBy("bucket").applyInArrow(count, f"{key_fields}, spans binary")


def _packed(first: np.ndarray, last: np.ndarray, doc: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Runs by document: packed pairs of each document, and the documents."""
    rows = np.unique(doc)
    pairs = np.stack([first, last], axis=1).astype("<i8")
    edges = np.searchsorted(doc, np.append(rows, np.iinfo(np.int64).max))
    return [pairs[s:e].tobytes() for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], rows


def _spans(heads: np.ndarray, doc: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    if not len(heads):
        return [], heads
    new = np.ones(len(heads), bool)
    new[1:] = (heads[1:] != heads[:-1] + 1) | (doc[1:] != doc[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(heads)) - 1
    return _packed(heads[s] - bounds[doc[s]], heads[e] - bounds[doc[s]], doc[s])


def _frame(strings: list[bytes], info: np.ndarray, owners: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.RecordBatch.from_arrays([pa.array(strings, pa.binary()), *(pa.array(info[:, i].astype(np.int32)) for i in range(3))], ["s", "d", "p", "k"])
    for part in (table, owners):
        with pa.ipc.new_stream(sink, part.schema) as out:
            out.write_batch(part)
    return sink.getvalue().to_pybytes()


def _unframe(data: bytes) -> tuple[pa.Array, np.ndarray, pa.RecordBatch]:
    source = pa.BufferReader(data)
    parts = []
    for _ in range(2):
        with pa.ipc.open_stream(source) as stream:
            parts.append(stream.read_all().combine_chunks().to_batches()[0])
    table, owners = parts
    return table.column("s"), np.stack([table.column(c).to_numpy() for c in ("d", "p", "k")], axis=1).astype(np.int64), owners


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with kept_words (the words left, array), n_words and n_removed; other columns stay.

    A word goes if a window of `window` words that covers it starts anywhere
    else too, in the same document included. Windows are judged on the texts as
    they came. Null and empty texts, and those shorter than a window, keep all
    their words; repeated rows are each other's repeats, so that all their
    windows go. Columns of docs with the names of the new ones are replaced.
    """
    docs = docs.drop("kept_words", "n_words", "n_removed")
    hashed, found = fresh(docs, "text_hash"), fresh(docs, "text_spans")
    keyed = docs.withColumn(hashed, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    keys = (id_col, hashed)
    spans = repeated_windows(keyed, window, keys, text_col).groupBy(*keys).agg(F.collect_list("spans").alias(found))
    on = F.col(f"l.{id_col}").eqNullSafe(F.col(f"r.{id_col}")) & (F.col(f"l.{hashed}") == F.col(f"r.{hashed}"))
    both = keyed.alias("l").join(spans.alias("r"), on, "left").select("l.*", f"r.{found}").drop(hashed)
    return both.mapInArrow(_removal(window, text_col, found, [f.name for f in both.schema]), _removed_schema(docs))


def _removed_schema(docs: DataFrame):
    return docs.select("*", F.array(F.lit("")).alias("kept_words"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed")).schema


def _removal(window: int, text_col: str, found: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                buf, offs = buffer_of(batch.column(text_col))
                words = Words(buf, offs)
                n = len(words.starts)
                cover = np.zeros(n + 1, np.int64)
                for i, packed in enumerate(batch.column(found).to_pylist()):
                    if packed:
                        pairs = np.frombuffer(b"".join(packed), "<i8").reshape(-1, 2) + words.bounds[i]
                        np.add.at(cover, pairs[:, 0], 1)
                        np.add.at(cover, pairs[:, 1] + window, -1)
                gone = np.cumsum(cover[:n]) > 0
                total = np.diff(words.bounds)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.bounds])
                kept = np.flatnonzero(~gone)
                raw = buf.tobytes()
                values = pa.array([raw[s:e] for s, e in zip(words.starts[kept].tolist(), words.ends[kept].tolist(), strict=True)], pa.binary()).cast(pa.string())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(total - removed)]).astype(np.int32)), values)
                left = [c for c, k in zip(batch.columns, names, strict=True) if k != found]
                yield pa.RecordBatch.from_arrays([*left, lists, pa.array(total), pa.array(removed)], [*(k for k in names if k != found), "kept_words", "n_words", "n_removed"])

    return run
