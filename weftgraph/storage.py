"""Shared-storage helpers: materialised intermediates and table reading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which the driver and all executors share.

    Where the session names none, a temporary folder takes its place if driver and executors are one process (tests); on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and (sc.master == "local" or sc.master.startswith("local[")):
        named = getattr(sc, "_weft_shared", None)
        if not named:
            own = tempfile.mkdtemp(prefix="weft-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            named = sc._weft_shared = f"file://{own}"
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


#: Folders written by ``materialise`` that are still there, with their session.
_OWNED: dict[str, SparkSession] = {}
_KEPT: dict[str, SparkSession] = {}


def materialise(df: DataFrame, label: str, light: bool = False) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives the loss of any executor.

    ``light``: a few bytes for each row of larger tables, written by an eighth of the tasks, so that there are not more files than need be.
    The folder lasts until ``discard`` or ``release``, at the latest until the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{label}-{uuid.uuid4().hex}"
    if light:
        df = df.coalesce(max(1, n_partitions(spark) // 8))
    df.write.parquet(path)
    _OWNED[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def new_folder(spark: SparkSession, label: str) -> str:
    """The path of a folder in the shared one, to be written to; it lasts as ``materialise``'s do."""
    path = f"{shared_dir(spark)}/weft-{label}-{uuid.uuid4().hex}"
    _OWNED[path] = spark
    return path


def snapshot(df: DataFrame, label: str) -> DataFrame:
    """A table that lasts as long as the session, written by the tasks that make its rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def _delete(path: str, spark: SparkSession) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    _OWNED.pop(path, None)
    _KEPT.pop(path, None)


def discard(df: DataFrame | None) -> None:
    """Delete a materialised table that nothing lazy refers to any more."""
    path = getattr(df, "_weft_path", None)
    if path:
        _delete(path, df.sparkSession)


def release(spark: SparkSession | None = None) -> int:
    """Delete every intermediate table of a session (or of all) once its results have been written; returns how many there were."""
    mine = [(path, own) for path, own in _OWNED.items() if spark is None or own is spark]
    for path, own in mine:
        _delete(path, own)
    return len(mine)


@atexit.register
def _at_exit() -> None:
    for path, own in [*_OWNED.items(), *_KEPT.items()]:
        try:
            if own.sparkContext._jsc is not None and own.sparkContext._jsc.sc().isStopped() is False:
                _delete(path, own)
        except Exception:  # noqa: BLE001  the JVM may be gone before the driver's Python
            return


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
