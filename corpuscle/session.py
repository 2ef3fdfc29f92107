"""Session plumbing: the shared work folder, lineage cuts and shipping this package to Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


_work: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a temporary one is made, but only if executors are threads of this machine."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = Path(tempfile.mkdtemp(prefix="corpuscle-")).as_uri()
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _work.append(path)
    return path


def discard(spark: SparkSession) -> int:
    """Delete the work tables made so far, and say how many. Only when no result is read from them any more."""
    gone = 0
    while _work:
        path = spark._jvm.org.apache.hadoop.fs.Path(_work.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a written table in the shared folder: cuts lineage, survives lost executors, and is computed once."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


ARROW_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Bound Arrow batches, and let Python workers import this package where neither PYTHONPATH nor the working directory has it."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, ARROW_ROWS)
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if str(ROOT) in (os.path.abspath(p) for p in known if p) or getattr(spark.sparkContext, "_corpuscle_shipped", False):
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "corpuscle"), "zip", ROOT, "corpuscle")
    spark.sparkContext.addPyFile(made)
    spark.sparkContext._corpuscle_shipped = True
