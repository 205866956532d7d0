"""Tables that several steps of an operator read, written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local session, as in tests, gets a temporary one;
    a cluster's executors wouldn't share that, so there it's an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ferrule-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """df, written and read again: its lineage ends here, and what is lost with an executor is read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def until_exit(spark: SparkSession, path: str) -> str:
    """Delete what's under a path when the Python process ends."""
    _written.append((spark, path))
    return path


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session ended first; the shared folder has its own expiry
            return
