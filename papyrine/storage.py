"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temp folder only for local masters that have none set."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="papyrine-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return "file://" + _local_dirs[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back.

    This cuts lineage (a lost executor re-reads files, not the whole plan) and computes df once.
    The tables are removed when the driver's interpreter ends; until then results may read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/papyrine-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    _forget_later(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget_later(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone by then
            pass

    atexit.register(remove)
