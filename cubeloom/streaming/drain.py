"""Draining as a Structured Streaming query.

The stream's source is the folder of the change log's commit files: each new
file is a wake-up. The entries themselves are claimed by the engine, whose
commits carry the log offset; a micro-batch that Spark replays after a crash
finds nothing left to apply.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame


def drain_stream(engine: Any, checkpoint: str, **trigger: Any):
    engine.log.append({})  # nothing is written; makes sure the log is reachable before the stream starts

    def apply(batch: DataFrame, batch_id: int) -> None:
        while engine.drain_step():
            pass

    commits = engine.spark.readStream.schema("value string").format("text").option("pathGlobFilter", "*.json").load(engine.log.commit_folder)
    return commits.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
