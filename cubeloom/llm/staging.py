"""Tables that cut lineage, written to the folder every executor shares.

The folder is the one the cluster names in ``spark.checkpoint.dir``. A session
in local mode that names none gets a temporary folder; a cluster session that
names none is refused, because executors there don't share local disks.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_staged: dict[str, list[str]] = {}
_begun: dict[str, int] = {}


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dirs.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="cubeloom-"))


def unique() -> str:
    return uuid.uuid4().hex[:12]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{unique()}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _plain_files(path: str) -> dict[str, str]:
    """Writer options for a folder that is mounted: no checksum file beside every file.

    Without its native library Hadoop starts a process (chmod) for every file it
    makes there, and until that process has its own image it shares the pages of
    the executor, whose memory then seems to double.
    """
    if not path.startswith(("file:", "/")):
        return {}
    return {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later uses neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(compression="zstd", **_plain_files(path)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go when it ends, not when the driver's garbage is collected. For tables that are staged: a later action on the same frame starts anew."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drop(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = hadoop_path(folder)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def begin(spark: SparkSession) -> None:
    """From here on, ``clear`` may delete what is staged."""
    app = spark.sparkContext.applicationId
    _begun[app] = len(_staged.setdefault(app, []))


def clear(spark: SparkSession) -> None:
    """Delete what was staged since ``begin``. Call it only when no result read from that is still to be computed."""
    sc = spark.sparkContext
    paths, hadoop_path = _staged.get(sc.applicationId, []), sc._jvm.org.apache.hadoop.fs.Path
    since = _begun.get(sc.applicationId, len(paths))
    for path in paths[since:]:
        p = hadoop_path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    del paths[since:]
