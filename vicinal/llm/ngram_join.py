"""N-gram Jaccard join by filters under several global orders.

A document is the set of its k-word shingles; two link when their Jaccard
similarity reaches num / den. Equal sets are folded to one node first.

Two sets that link share at least l of their first n - o + l shingles under any
one order of all shingles, where o is the overlap that the similarity asks for.
A sample under one random order, of that length, is therefore enough to look at:
a node of whose sample fewer than l shingles occur in another node's sample
links with nothing. Of what occurs elsewhere, each of several orders (rare
shingles first, in classes of different width, ties by different hashes) again
has a prefix in which two nodes that link must meet.

That filter is taken twice. Nodes that meet, directly or by way of others, under
one order have one label of that order, and only nodes all of whose labels agree
come to one group. Sizes of sets that link differ by a bounded factor: labels are
drawn up within classes of size, of which a node is in its own and the next, so
that chains end early. Inside a group, in blocks of bounded size, the pairs that
share a prefix token under each order are found by matrix products; the filters
of all orders are intersected, and only pairs that pass all are verified on their
whole sets. A task returns a spanning forest of the links it finds, never all
pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .runtime import fresh, materialise, remove
from .textkit import Words, gram_hashes, mix64, slices, unique_per_doc

#: One shingle in so many by which samples are longer than a plain prefix.
SURPLUS = 16
#: Orders under which nodes must meet; nodes of a block, and shingles of all its sets, about.
ORDERS, BLOCK, BLOCK_SHINGLES = 3, 1024, 1 << 21
#: More than there are classes of size.
CLASSES = 1_000_000
#: Sets that a task remembers to have sent a sample of.
REMEMBERED = 200_000

_SALT = np.uint64(0x5851F42D4C957F2D)


def _need(n, num: int, den: int):
    """Shingles that a set of n must share with any set it links with."""
    return (num * n + den - 1) // den


def _sets(column: pa.Array, k: int):
    """For each run of rows: first row, end row, distinct shingles by row, their bounds."""
    for a, b, buf, offs in slices(column):
        words = Words(buf, offs)
        grams, docs = gram_hashes(words.hashes(lower=True), words.bounds, k)
        yield (a, b, *unique_per_doc(grams, docs, b - a))


def _signatures(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit hashes of each row's set."""
    out = []
    for salt in (np.uint64(0), _SALT):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(values ^ salt))])
        out.append(mix64(total[bounds[1:]] - total[bounds[:-1]] + salt).view(np.int64))
    return out[0], out[1]


def _sampled(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """s1, token: the sample of every set, once a task and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for _, _, values, bounds in _sets(batch.column("text"), k):
                one, _ = _signatures(values, bounds)
                n = np.diff(bounds)
                take = np.where(n > 0, np.minimum(n, n - _need(n, num, den) + 1 + n // SURPLUS), 0)
                for i, s in enumerate(one.tolist()):
                    if s in sent:
                        take[i] = 0
                    elif take[i]:
                        sent.add(s)
                if len(sent) > REMEMBERED:
                    sent.clear()
                row = np.repeat(np.arange(len(n)), n)
                order = _by_row(mix64(values), row)
                rank = np.arange(len(values)) - bounds[:-1][row]
                picked = rank < take[row]
                yield pa.RecordBatch.from_arrays([pa.array(one[row[picked]]), pa.array(values[order][picked].view(np.int64))], ["s1", "token"])

    return docs.select("text").mapInArrow(run, "s1 long, token long")


def _by_row(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Order that sorts keys within each row; rows stay in order."""
    first = np.argsort(keys)
    return first[np.argsort(row[first].astype(np.uint16 if not len(row) or row[-1] < 1 << 16 else np.int64), kind="stable")]


def _described(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, s1, s2 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, bounds in _sets(batch.column("text"), k):
                one, two = _signatures(values, bounds)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(bounds)), pa.array(one), pa.array(two)], ["doc_id", "n", "s1", "s2"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long")


def _prefixes(samples: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """node, n, size (class), p: for each order the tokens of the node's prefix. Nodes that can link with none are left out."""
    shared = samples.groupBy("token").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi"), F.count("*").alias("df")).where("lo <> hi").select("token", "df")
    shared = materialise(shared, "shared")
    met = samples.join(shared, "token").groupBy("s1").agg(F.collect_set(F.struct("df", "token")).alias("k"))
    need = F.lit(1) + F.floor(F.floor((F.lit(num) * F.col("n") + F.lit(den - 1)) / F.lit(den)) / F.lit(SURPLUS))
    kept = met.join(nodes, "s1").withColumn("m", (F.size("k") - need + 1).cast("int")).where("m > 0")
    key = [
        lambda x: F.struct(x["df"].alias("c"), F.xxhash64(x["token"], F.lit(0)).alias("h"), x["token"].alias("t")),
        lambda x: F.struct(F.floor(F.log2(x["df"].cast("double")) + F.lit(1e-9)).alias("c"), F.xxhash64(x["token"], F.lit(1)).alias("h"), x["token"].alias("t")),
        lambda x: F.struct(F.floor((F.floor(F.log2(x["df"].cast("double")) + F.lit(1e-9)) + 1) / 2).alias("c"), F.xxhash64(x["token"], F.lit(2)).alias("h"), x["token"].alias("t")),
    ]
    # one class to another: the factor by which sizes of sets that link may differ, and a hair for rounding
    size = F.floor(F.log(F.col("n").cast("double")) / (max(math.log(den / num), 1e-6) * (1 + 1e-9))).cast("int")
    prefix = lambda i: F.transform(F.slice(F.array_sort(F.transform("k", key[i])), F.lit(1), F.col("m")), lambda x: x["t"])
    made = materialise(kept.select("node", "n", size.alias("size"), F.array(*[prefix(i) for i in range(ORDERS)]).alias("p")), "prefixes")
    remove(shared)
    return made


def _meetings(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """g, u, v: for each order and class of size, every node of a prefix token and the least node of that token; and a table to remove."""
    spot = lambda i, c: F.transform(F.col("p")[i], lambda t: F.struct((F.lit(i * CLASSES + c) + F.col("size")).alias("g"), t.alias("token")))
    spread = prefixes.select("node", F.explode(F.concat(*[spot(i, c) for i in range(ORDERS) for c in (0, 1)])).alias("x")).select("x.g", "x.token", "node")
    least = materialise(spread.groupBy("g", "token").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v <> w").select("g", "token", "v"), "meetings")
    return spread.join(least, ["g", "token"]).select("g", F.col("node").alias("u"), "v").where("u <> v").distinct(), least


def _blocks(labels: DataFrame, prefixes: DataFrame) -> DataFrame:
    """node, n, p, grp, blocks, block: groups of nodes all of whose labels agree, dealt to blocks."""
    labels = labels.withColumn("size", F.col("g") % CLASSES)
    agreed = labels.groupBy("node", "size").agg(F.count("*").alias("c"), F.sort_array(F.collect_list(F.struct("g", "root"))).alias("ls")).where(F.col("c") == ORDERS)
    named = materialise(agreed.select("node", F.xxhash64("ls").alias("grp")).join(prefixes.select("node", "n", "p"), "node"), "groups")
    sizes = named.groupBy("grp").agg(F.count("*").alias("size"), F.sum("n").alias("all")).where("size > 1")
    sizes = materialise(sizes.select("grp", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "sizes")
    made = materialise(named.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")), "blocks")
    remove(named, sizes)
    return made


def _common(rows: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair of rows shares; elements of a row are distinct."""
    n = len(rows)
    tokens = np.concatenate(rows) if n else np.zeros(0, np.uint64)
    who = np.repeat(np.arange(n), [len(x) for x in rows])
    by = np.argsort(tokens, kind="stable")
    t, w = tokens[by], who[by]
    starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, int)
    counts = np.diff(np.append(starts, len(t)))
    common = np.zeros((n, n), np.float32)
    for d in range(2, min(n, 8) + 1):  # elements of few rows: every pair of them once
        at = starts[counts == d]
        for i in range(d):
            for j in range(i + 1, d):
                np.add.at(common, (w[at + i], w[at + j]), 1)
    common += common.T
    many = np.flatnonzero(counts > 8)
    for i in range(0, len(many), 2048):  # the rest: products of incidence matrices
        part = many[i : i + 2048]
        inc = np.zeros((n, len(part)), np.float32)
        col = np.repeat(np.arange(len(part)), counts[part])
        pos = np.repeat(starts[part] - (np.cumsum(counts[part]) - counts[part]), counts[part]) + np.arange(len(col))
        inc[w[pos], col] = 1
        common += inc @ inc.T
    return common


def link_forest(nodes: np.ndarray, sets: list[np.ndarray], prefixes: list[list[np.ndarray]], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that link with a smaller one, directly or through others, and the least node each reaches.

    prefixes: for each order the prefix of each node. Only pairs that share a
    token under every order are verified.
    """
    order = np.argsort(nodes, kind="stable")
    nodes, sets = nodes[order], [sets[i] for i in order]
    n = len(nodes)
    size = np.array([len(s) for s in sets])
    candidate = ~np.eye(n, dtype=bool)
    for prefix in prefixes:
        candidate &= _common([prefix[i] for i in order]) > 0
    link = np.eye(n, dtype=bool)
    i, j = np.nonzero(np.triu(candidate))
    if len(i) > 4 * n:
        common = _common(sets)[i, j].astype(np.int64)
    else:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    good = den * common >= num * (size[i] + size[j] - common)
    link[i[good], j[good]] = link[j[good], i[good]] = True
    root = np.arange(n)
    while True:
        new = np.where(link, root[None, :], n).min(axis=1)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(nodes[root] != nodes)
    return nodes[moved], nodes[root[moved]]


def _verified(docs: DataFrame, blocks: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """u, v: forests of the links inside each pair of blocks of a group."""
    wanted = blocks.join(nodes.select("node", "s1", "s2"), "node").select(F.col("node").alias("doc_id"), "s1", "s2", "grp", "blocks", "block", "p")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["grp", "blocks", "block", "p"]
        for batch in batches:
            for a, b, values, bounds in _sets(batch.column("text"), k):
                one, two = _signatures(values, bounds)
                part = batch.slice(a, b - a)
                same = (one == part.column("s1").to_numpy()) & (two == part.column("s2").to_numpy())
                blobs = [values[s:e].tobytes() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(c) for c in names), pa.array(blobs, pa.binary())], ["node", *names, "set"])
                yield out.filter(pa.array(same))

    sets = docs.join(wanted, "doc_id").select("doc_id", "text", "s1", "s2", "grp", "blocks", "block", "p").mapInArrow(to_sets, "node long, grp long, blocks int, block int, p array<array<long>>, set binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = sets.select("node", "grp", "set", "p", "block", other).select("node", "grp", "set", "p", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pair of blocks at a time; its rows follow each other."""
        held, name = [], None

        def forest() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            node = table.column("node").to_numpy()
            rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set").combine_chunks()]
            of = table.column("p").to_pylist()
            u, v = link_forest(node, rows, [[np.array(x[o], np.int64) for x in of] for o in range(ORDERS)], num, den)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("grp", "i", "j")], axis=1)
            edge = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True]) if len(keys) else np.zeros(1, int)
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                key = tuple(keys[s])
                if key != name:
                    if sum(x.num_rows for x in held) > 1:
                        yield forest()
                    held, name = [], key
                held.append(batch.slice(s, e - s))
        if sum(x.num_rows for x in held) > 1:
            yield forest()

    return paired.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(compare, "u long, v long")


def components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Words are those between ASCII white space, A-Z lower-cased; a document of
    fewer than k words is one shingle. component_id is the smallest id that
    links reach, the own id without links. Null and empty texts have no shingles
    and link with nothing, not even each other. Rows without an id get no
    component and link with nothing; ids are taken to be unique, and rows that
    repeat an id are judged each by its own text. A text is taken whole, however
    long; a task holds the shingles of a run of texts, about 16 bytes a word. An
    empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    light = materialise(_described(docs, k), "sets")
    whole = light.where("n > 0 AND doc_id IS NOT NULL")
    nodes = materialise(whole.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node")), "nodes")
    samples = materialise(_sampled(docs.where(F.col("doc_id").isNotNull()), k, num, den), "samples")
    prefixes = _prefixes(samples, nodes, num, den)
    remove(samples)
    edges, least = _meetings(prefixes)
    blocks = _blocks(connected_components(edges), prefixes)
    remove(least, prefixes)
    links = _verified(docs, blocks, nodes, k, num, den).select(F.lit(0).alias("g"), "u", "v")
    roots = connected_components(links).select("node", "root")
    placed = materialise(nodes.join(roots, "node", "left").select("s1", "s2", "n", F.coalesce("root", "node").alias("root")), "placed")
    remove(blocks)
    both = light.join(placed, ["s1", "s2", "n"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("root")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs (with doc_id, text) with the one document of each component whose id is the component's.

    Documents without words stay all, as do rows without an id. Ids are taken to
    be unique: rows that repeat the id of a component all stay, and all rows of an
    id go if one of them belongs to another id's component. Columns are those of
    docs.
    """
    gone = fresh(docs, "gone_id")
    found = components(docs, k, num, den).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, F.col("doc_id") == F.col(gone), "left_anti")
