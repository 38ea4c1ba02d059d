"""Settings of an engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    #: Days are cut in this zone; timestamps without a zone are read as UTC.
    time_zone: str = "UTC"
    #: Change-log entries that one drain step claims.
    batch_size: int = 1000
    #: A drain stops claiming after so many seconds; it always does one step.
    max_run_seconds: float = 30.0
    #: Hash buckets of a rollup table; a drain rewrites only buckets with affected cells.
    buckets: int = 8
    #: Most entries that may be pending when a drain starts; None: no limit.
    max_pending: int | None = None
    #: Affected cells up to this many are broadcast; their number is counted first.
    broadcast_cells: int = 100_000
    table_prefix: str = "cube_"
    #: Folder of the change log below the engine's.
    log_name: str = "changes"
    #: Name of the logger that the engine reports to.
    logger: str = "cubeloom"
    #: How often a drain takes up a rollup again that another writer committed to meanwhile.
    commit_attempts: int = 5

    def __post_init__(self) -> None:
        if min(self.batch_size, self.buckets, self.commit_attempts) < 1:
            raise ValueError("batch_size, buckets and commit_attempts are at least 1")
