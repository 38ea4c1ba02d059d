"""Length buckets that minimise padding, and token-budget batches inside them.

A dynamic program over the corpus-wide length histogram chooses the bucket
boundaries: every text is padded to its bucket's boundary, and no other choice
of that many histogram cells pads less. Up to EXACT words a length is a cell of
its own; longer ones share cells, whose upper ends are the boundaries, so there
the choice is optimal over cells, 0.1 to 0.2 % wide. Batches then fill inside each bucket: as
all texts of a bucket have one padded length, a batch is a fixed number of
texts. The histogram has a bounded number of cells whatever the corpus; text
positions inside a bucket come from ``ranks.running``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running
from .staging import stage
from .texts import word_count

#: Lengths up to this are histogram cells of their own; above, a cell spans 1/EXACT of its length.
EXACT = 1024


def cell_of(length: Column) -> Column:
    """The smallest cell boundary that isn't below ``length``: at most EXACT cells, plus EXACT / 2 per doubling."""
    shift = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - (EXACT.bit_length() - 2))
    step = F.pow(F.lit(2.0), shift).cast("long")
    return (F.ceil(length / step) * step).cast("long")


def choose_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries among ``lengths`` (ascending) that minimise the summed padding of ``counts`` texts."""
    n = len(lengths)
    if not n:
        return []
    total = np.concatenate(([0], np.cumsum(counts, dtype=np.float64)))
    # Padding of cells i..j-1 in one bucket is lengths[j-1] * texts - words, and the words are the same for all choices.
    best = np.where(np.arange(n + 1) == 0, 0.0, np.inf)
    back = []
    for _ in range(min(buckets, n)):
        after, choice = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        after[0] = 0.0
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (total[j] - total[:j])
            choice[j] = int(np.argmin(cost))
            after[j] = cost[choice[j]]
        best = after
        back.append(choice)
    bounds, j = [], n
    for choice in reversed(back):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(choice[j])
    return bounds[::-1]


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, length): words of every whole text, a word being a run free of blanks."""

    return docs.select(F.col(id_col).alias("id"), word_count(F.col(f"`{text_col}`").cast("string")).alias("length"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 12, token_budget: int = 16384) -> DataFrame:
    """(id, length, bucket, boundary, batch, slot) for every row of ``docs``.

    ``length`` is the text's words (null: 0). ``bucket`` counts from 0 by
    length; ``boundary`` is the padded length. Batch ``batch`` of a bucket holds
    as many texts, ordered by id, as fit ``token_budget`` padded words, one at
    least; ``slot`` is the place inside it. A text longer than the budget is a
    batch of its own. Repeated rows are packed each; null ids come last; an
    empty table gives an empty result.
    """
    lengths = stage(word_counts(docs, id_col, text_col), "pack-lengths")
    # At most EXACT + EXACT / 2 * 53 rows, one per histogram cell.
    histogram = lengths.groupBy(cell_of(F.col("length")).alias("cell")).agg(F.count("*").alias("n")).orderBy("cell").collect()
    bounds = choose_boundaries(np.array([h.cell for h in histogram], dtype=np.float64), np.array([h.n for h in histogram]), buckets)
    limits = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    bucket = F.size(F.filter(limits, lambda b: b < F.col("length")))
    placed = running(
        lengths.select("id", "length", bucket.cast("int").alias("bucket"), F.lit(1).cast("long").alias("one")),
        "bucket",
        [F.col("id").asc_nulls_last(), F.col("length")],
        "one",
    )
    boundary = F.element_at(limits, F.col("bucket") + 1)
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(boundary, F.lit(1)))).cast("long")
    return placed.select(
        F.col("id").alias(id_col), "length", "bucket", boundary.alias("boundary"), F.floor(F.col("place") / room).cast("long").alias("batch"), (F.col("place") % room).alias("slot")
    )
