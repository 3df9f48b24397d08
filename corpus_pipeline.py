"""A training-data pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next one's docs. All but the last return the
columns of documents. Every stage works on the whole texts of all the rows that
the stages before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm import mixing, ngram_join, packing, quality_cnn, substring_dedup
from vicinal.llm.runtime import default_tokenizer, materialise, remove, table

#: Documents with a lower probability of good quality go.
LEAST_QUALITY = 0.3
#: Words of a passage that may not occur twice.
PASSAGE = 50

#: SQL cannot express the classifier, the similarity join or the packing; tests compare with plain Python.
ORACLE_SQL = None


def _apart(docs: DataFrame, *taken: str):
    """docs without clashes with the columns that an operator adds, and a function that gives docs' own columns back."""
    own = {c: f"_own_{c}" for c in docs.columns if c.lower() in taken}
    return docs.withColumnsRenamed(own), lambda df: df.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least LEAST_QUALITY."""
    docs, back = _apart(docs, "score")
    scored = quality_cnn.quality_scores(docs, table(spark, sf_dir, "labels"))
    return back(scored.where(F.col("score") >= LEAST_QUALITY))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles link at a similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occur anywhere else too.

    A text that loses nothing stays as it is; else its kept words are joined by
    one blank. A document that loses all its words stays, with an empty text.
    """
    docs, back = _apart(docs, "kept_words", "n_words", "n_removed")
    made = substring_dedup.remove_repeats(docs, window=PASSAGE)
    text = F.when(F.col("n_removed") > 0, F.array_join("kept_words", " ")).otherwise(F.col("text"))
    made = made.withColumn("text", text)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return back(made)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates of the target mix say."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    made = packing.pack(docs, default_tokenizer())
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of sf_dir; what a stage wrote goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage{i + 1}")
        if i:
            remove(before)
    return docs
