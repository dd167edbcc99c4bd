"""Tables written between the stages of an operator.

They cut the lineage and let several later stages read one result. They lie in the folder that all executors share,
named by ``spark.checkpoint.dir``, so that losing an executor loses nothing.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark removes the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    named = named or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cinegrid-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/cinegrid/{uuid.uuid4().hex}/{name}"
    _written.append((spark, path))
    return path


def hadoop_path(spark: SparkSession, path: str):
    """The path as a Hadoop object, and its file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Writes ``df`` once and returns the written table. ``tidy``: what the write shuffled is removed when it is over, not only when
    the driver happens to collect its garbage."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    if tidy:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes a table that ``written`` gave; nothing may read it afterwards."""
    files = df.inputFiles()
    for entry in [e for e in _written if files and e[1].rpartition("/cinegrid/")[2] in files[0]]:
        where, fs = hadoop_path(*entry)
        fs.delete(where.getParent(), True)
        _written.remove(entry)


@contextmanager
def scope():
    """Removes at its end what was written in it, so that a long session does not keep it; results must be taken by then."""
    begun = len(_written)
    try:
        yield
    finally:
        clear(begun)


def clear(keep: int = 0) -> None:
    """Removes the tables written so far, but for the first ``keep``; results that still read them become invalid."""
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            where, fs = hadoop_path(spark, path)
            fs.delete(where.getParent(), True)
        except Exception:  # the session is gone; the cluster clears its folder
            pass


atexit.register(clear)
