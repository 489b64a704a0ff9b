"""Session helpers: the shared folder, tables written to cut lineage, and size checks."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of sessions without a shared one, by application.
_PRIVATE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read.

    The cluster names it in ``spark.checkpoint.dir``. A private temporary folder is made only where that is unset,
    as in tests on one machine; on a cluster, whose executors could not read it, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _PRIVATE:
        own = tempfile.mkdtemp(prefix="lodestream-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _PRIVATE[app] = f"file:{own}"
    return _PRIVATE[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestream-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> bool:
    """Delete the tables that this application has written to the shared folder; results that read them must be stored before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage with files that outlive executors, so a lost executor costs only its running tasks. ``release`` deletes
    them at the end.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of ``folder`` by name."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, tasks_per_core: int = 2) -> DataFrame:
    """Spread few or large files over all cores before heavy per-row work; many partitions stay as they are.

    For scans and projections of scans only: to count partitions of a plan with a shuffle would run that shuffle.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * tasks_per_core
    return df.repartition(want) if df.rdd.getNumPartitions() < want // 2 else df


def broadcast_within(df: DataFrame, limit_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast only if a count shows at most ``limit_rows`` rows; else leave the join to shuffle."""
    few = df.limit(limit_rows + 1).agg(F.count(F.lit(1))).first()[0] <= limit_rows
    return F.broadcast(df) if few else df
