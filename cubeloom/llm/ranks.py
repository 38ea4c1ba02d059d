"""Positions and running sums inside groups of any size, without a task per group.

A window over a group sorts the whole group in one task. Here rows are
range-partitioned by (group, order): a large group spans many partitions. One
streaming pass sums inside each partition, a small table of partition totals
(partitions plus groups rows) gives each piece its offset, and a join adds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage


def running(df: DataFrame, group: str, order: list, value: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``before`` (sum of ``value`` over earlier rows of the group) and ``place`` (rows before it).

    ``group`` must not be null; ``value`` is a non-null long. Rows that tie in
    ``order`` get distinct places. ``df`` is read twice, so stage costly input.
    """
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = df.columns
    group_at, value_at = columns.index(group), columns.index(value)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        last, total, count = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            groups = batch.column(group_at).dictionary_encode()
            codes = groups.indices.to_numpy()
            values = batch.column(value_at).to_numpy()
            ends = np.flatnonzero(np.append(codes[1:] != codes[:-1], True)) + 1
            before, place = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
            start = 0
            for end in ends.tolist():
                name = groups.dictionary[int(codes[start])].as_py()
                if name != last:
                    last, total, count = name, 0, 0
                sums = np.cumsum(values[start:end])
                before[start:end] = total + sums - values[start:end]
                place[start:end] = count + np.arange(end - start)
                total += int(sums[-1])
                count += end - start
                start = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(place), pa.array(np.full(n, piece, dtype=np.int32))], names=[*columns, "before", "place", "piece"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    ranged = df.repartitionByRange(parts, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    pieces = stage(ranged.mapInArrow(local, f"{shape}, before long, place long, piece int"), "running")
    totals = pieces.groupBy(group, "piece").agg(F.sum(value).alias("sum"), F.count("*").alias("rows"))
    earlier = Window.partitionBy(group).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "piece", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("sum"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows"))
    # Most pieces start a group and need no offset; only the others go through the join's table.
    moved = stage(offsets.where("rows > 0"), "offsets").select(F.struct(group, "piece", "sum", "rows").alias("_offset"))
    joined = pieces.join(moved, (F.col(group) == F.col(f"_offset.{group}")) & (F.col("piece") == F.col("_offset.piece")), "left")
    add = {"before": "_offset.sum", "place": "_offset.rows"}
    return joined.select(*columns, *[(F.col(c) + F.coalesce(F.col(o), F.lit(0))).alias(c) for c, o in add.items()])
