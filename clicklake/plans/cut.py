"""Tables written between the stages of an iterative or twice-read plan."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. Where that is unset, a temporary one, and only if the executors
    are threads of this process (tests, one machine); a cluster must name its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        found = tempfile.mkdtemp(prefix="clicklake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextmanager
def scoped() -> Iterator[None]:
    """Deletes at its end every table that was cut within: for callers who have by then used up what their queries returned.

    A query gives a lazy frame, so only its caller knows when the tables behind it have done their duty. Without a scope they
    last until the session ends, but for those an operator can drop itself.
    """
    before = set(path for _, path in _written)
    try:
        yield
    finally:
        for spark, path in [x for x in _written if x[1] not in before]:
            _delete(spark, path)
        _written[:] = [x for x in _written if x[1] in before]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write `df` once into the shared folder and read it back: the lineage ends there and lost executors cost nothing.

    The files live until the session ends, the enclosing `scoped` does, or `drop` is called with the returned frame.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_drop_all)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._clicklake_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table behind a frame from `cut`; nothing may read it afterwards."""
    path = getattr(df, "_clicklake_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; its folder is the cluster's to clean
            return


def spread(df: DataFrame) -> DataFrame:
    """At least as many partitions as cores, for Python work on tables of few files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
