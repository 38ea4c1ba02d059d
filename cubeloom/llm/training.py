"""Bounded labelled samples for the classifiers, and folds by id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import portions


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, text, y) of at most ``most`` documents of each label, 0 and 1, none of fold ``held_out``.

    Rows are chosen by a hash of their ids, so reruns agree and no order of the
    table matters. Labels other than 0 and 1, and those of ids that ``docs``
    lacks, are ignored; of several labels for an id the largest counts, of
    several texts one. At most 2 * ``most`` ids are broadcast.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (fold(id_col, folds) != held_out))
    known = known.groupBy(F.col(id_col).alias("i")).agg(F.max(label).cast("int").alias("y"))
    known = known.join(docs.select(F.col(id_col).alias("i")), "i", "left_semi")
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(most) for y in (0, 1)]
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("d") == F.col("i"))
    return rows.groupBy("d").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))


def scored_rows(docs: DataFrame, make: Callable[[], Callable[[str | None], float]], text_col: str, name: str, keep: list[str] | None) -> DataFrame:
    """Columns ``keep`` (default: all) of every row, and the score that a function from ``make``, made once a task, gives its text."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    shape = T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = make()
        for batch in portions(batches):
            scores = [run(t) for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(scores, pa.float64())], names=[*kept, name])

    texts = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("_text_to_score"))
    return texts.mapInArrow(scored, shape)
