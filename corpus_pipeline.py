"""From raw documents to packed training batches, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller
writes as Parquet and rereads as the next stage's documents.

Null and empty texts are never toxic, have no lines to lose, resemble nothing
and have no words, so mixing takes nothing of them and they end there. Rows with
a null id pass toxicity, lines and near copies, are mixed by text and source and
are packed last. Rows that repeat an id are judged each by its own text; equal
rows of an id are one document for near copies. Columns beyond those of
``documents`` pass through, whatever they are called, up to packing. Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm import line_dedup, minhash, mixing, packing, staging, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of ``sf_dir``, scores below 0.5; all if the labels can't tell texts apart."""
    staging.begin(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model.constant:
        return docs
    return toxicity.score(docs, model, "text", "_toxicity").where(F.col("_toxicity") < 0.5).drop("_toxicity")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stay in another document; ``n_chars`` follows the text."""
    staging.clear(spark)
    reduced = line_dedup.keep_lines(docs, line_dedup.line_dedup(docs)).select(*docs.columns)
    return _counted(reduced)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8."""
    staging.clear(spark)
    return minhash.keep_one(docs, minhash.near_duplicates(docs, words=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: a row per pass, the last one of a source cut to its budget."""
    staging.clear(spark)
    return _counted(mixing.draw(docs, mixing.mix(docs)))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every row."""
    staging.clear(spark)
    return packing.pack(docs)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: A trained classifier takes part, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``; earlier stages' rows are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{staging.shared_dir(spark)}/{spark.sparkContext.applicationId}-pipeline-{staging.unique()}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
