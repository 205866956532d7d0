"""Tables that several stages read, in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
#: The folder of each kept table.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Whether Spark deletes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session, as in tests, gets a temporary one if none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ferrule-"))
    return sc.getCheckpointDir()


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it; clusters ship it with --py-files."""
    folder = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if folder not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, folder]))


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor
    costs only its running tasks. The folder goes with `let_go`, or when the Python process ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/ferrule-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    _written.append((spark, folder))
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    _folders[out] = folder
    return out


def let_go(*tables: DataFrame) -> None:
    """Delete kept tables that nothing reads any more."""
    for df in tables:
        spark, folder = df.sparkSession, _folders.pop(df)
        delete(spark, folder)
        _written.remove((spark, folder))


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for columns beside those of df: each with as many underscores in front as it takes."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def mark() -> int:
    """A point in the list of kept tables, for `forget`."""
    return len(_written)


def forget(since: int) -> None:
    """Delete the tables that were kept since then: what was made of them is written."""
    while len(_written) > since:
        delete(*_written.pop())


def until_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the Python process ends."""
    _written.insert(0, (spark, path))


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session ended first; the shared folder has its own expiry
            return
