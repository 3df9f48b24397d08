"""Sources and sinks: labelled vectors, replay corpora, raw binaries, results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from io import BytesIO
from os import environ
from os.path import join
from tempfile import gettempdir
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.features import PAYLOAD
from ..functions.vectors import quantise

LABELLED = T.StructType([T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("label", T.StringType())])
CORPUS = T.StructType([
    T.StructField("entries", T.ArrayType(T.StructType([T.StructField("request", PAYLOAD), T.StructField("expected_approved", T.BooleanType())]))),
    T.StructField("stats", T.StructType([T.StructField("total", T.LongType()), T.StructField("fraud_count", T.LongType()), T.StructField("fraud_rate", T.DoubleType()), T.StructField("legit_count", T.LongType()), T.StructField("legit_rate", T.DoubleType()), T.StructField("edge_case_rate", T.DoubleType())])),
])


@dataclass
class Settings:
    """Parameters of the offline steps; each can be set by an environment variable of its name in capitals."""

    box_k: int = 25
    halo: float = 0.23
    nlist: int = 512
    nprobe: int = 16
    rounds: int = 1000
    seed: int = 42

    @classmethod
    def from_env(cls, env=environ) -> Settings:
        return cls(**{f.name: type(f.default)(env[f.name.upper()]) for f in fields(cls) if f.name.upper() in env})


def labelled_vectors(spark: SparkSession, path: str) -> DataFrame:
    """ref_id, vec, q, is_fraud of a JSON array of vectors and labels; gzip is transparent.

    A JSON array cannot be split, so that the rows are dealt anew after reading.
    """
    rows = spark.read.schema(LABELLED).json(path, multiLine=True)
    made = rows.withColumn("ref_id", F.monotonically_increasing_id()).repartition("ref_id")
    return made.select("ref_id", F.col("vector").cast("array<float>").alias("vec"), quantise(F.col("vector")).alias("q"), (F.col("label") == "fraud").alias("is_fraud"))


def replay_corpus(spark: SparkSession, path: str) -> DataFrame:
    """index, expected_approved and the payload columns of a corpus of requests."""
    one = _corpus(spark, path)
    return one.select(F.posexplode("entries").alias("index", "e")).select("index", "e.expected_approved", "e.request.*")


def _corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).json(path, multiLine=True)


def corpus_stats(spark: SparkSession, path: str) -> DataFrame:
    """What a corpus of requests says about itself: total, counts and rates, a row a file."""
    return _corpus(spark, path).select("stats.*")


def npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """file, id, vec of two-dimensional .npy files of numbers in row-major order, headers read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                made = np.load(BytesIO(content.as_py()), allow_pickle=False)
                if made.ndim != 2:
                    raise ValueError(f"{name}: {made.ndim} dimensions, but vectors have 2")
                for a in range(0, len(made), 10000):
                    part = np.ascontiguousarray(made[a : a + 10000], np.float64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * made.shape[1]), pa.array(part.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(np.arange(a, a + len(part))), lists], ["file", "id", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, id long, vec array<double>")


def write_raw(df: DataFrame, path: str, dims: int, stride: int) -> None:
    """Vectors (id, vec) as rows of `stride` 32-bit floats, dims of them and zeros, in the order of ids.

    Spark's own writer commits them: one Parquet column of packed rows, of which
    `read_packed` or any reader takes the bytes as they stand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, stride), "<f4")
            if batch.num_rows:
                rows[:, :dims] = np.array(batch.column("vec").to_pylist(), np.float64)[:, :dims]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "row"])

    df.select(F.col("id").cast("long").alias("id"), "vec").repartitionByRange("id").sortWithinPartitions("id").mapInArrow(run, "id long, row binary").write.mode("overwrite").parquet(path)


def read_packed(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """id, vec of what `write_raw` wrote, without the padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(r.as_py(), "<f4")[:dims].astype(np.float64).tolist() for r in batch.column("row")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(pa.float64()))], ["id", "vec"])

    return spark.read.parquet(path).mapInArrow(run, "id long, vec array<double>")


MODEL = "name string, sizes array<int>, activation string, weights array<double>"


def save_model(spark: SparkSession, path: str, name: str, sizes: tuple[int, ...], weights: list[float], activation: str = "tanh") -> None:
    """A network as one row of a registry of models: its layers' sizes, activation and weights, layer by layer."""
    spark.createDataFrame([(name, list(sizes), activation, list(weights))], MODEL).coalesce(1).write.mode("append").parquet(path)


def load_model(spark: SparkSession, path: str, name: str) -> tuple[tuple[int, ...], str, list[float]]:
    """Sizes, activation and weights of the model of that name; an error if there is none or more than one."""
    rows = spark.read.schema(MODEL).parquet(path).where(F.col("name") == name).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} models are named {name}")
    return tuple(rows[0].sizes), rows[0].activation, list(rows[0].weights)


def raw_vectors(spark: SparkSession, path: str, dims: int, stride: int, kind: str = "<f4") -> DataFrame:
    """id, vec of headerless row-major binaries of `stride` numbers a row, the first dims of which count.

    ids count the rows of a file: across files a row is told by file and id. A
    file that is no whole number of rows is an error.
    """
    width = np.dtype(kind).itemsize * stride

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py()
                if len(data) % width:
                    raise ValueError(f"{name}: {len(data)} bytes are no whole number of rows of {width}")
                rows = np.frombuffer(data, kind).reshape(-1, stride)[:, :dims].astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dims), pa.array(rows.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(np.arange(len(rows))), lists], ["file", "id", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, id long, vec array<double>")


def check_dims(df: DataFrame, vec_col: str, dims: int) -> DataFrame:
    """n, bad: rows, and rows whose vector is null or has another number of dimensions."""
    wrong = F.col(vec_col).isNull() | (F.size(vec_col) != dims)
    return df.agg(F.count("*").alias("n"), F.sum(F.when(wrong, 1).otherwise(0)).cast("long").alias("bad"))


_kept: dict[tuple[str, str], DataFrame] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a session in one process has a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (found or "file://" + join(gettempdir(), "checkpoints")).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: for rows that a plan needs twice and that are dear to make. Deleted with the session."""
    spark = df.sparkSession
    where = f"{scratch(spark)}/vicinal-{uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def once(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make gives, written on the first call of a session and read back on every one."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _kept:
        _kept[key] = written(make())
    return _kept[key]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def written_at(spark: SparkSession, path: str) -> int:
    """When the table at path was finished, in milliseconds; 0 if it was not."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else 0


def materialise_once(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False, after: tuple[str, ...] = ()) -> DataFrame:
    """The Parquet table at path, made first if it is not finished, if it is older than one of the tables it comes after, or if force is set."""
    if force or written_at(spark, path) <= max([written_at(spark, a) for a in after], default=-1) or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_series(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """CSV with a header; doubles have three decimals."""
    shown = [F.format_string("%.3f", c).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in columns]
    df.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document a row."""
    df.write.mode("overwrite").json(path)
