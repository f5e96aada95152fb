"""Cutting lineage through tables in the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (tests, a laptop) a
local folder of our own takes its place.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables; the session's setting, or one of our own if it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        key = spark.sparkContext.applicationId
        if key not in _own:
            _own[key] = "file://" + tempfile.mkdtemp(prefix="coppice-")
        return _own[key]
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def written(df: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back: a cut lineage that
    survives the loss of executors. The table is removed by :func:`dropped`, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/coppice-{uuid.uuid4().hex}"
    _made[path] = spark
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _path_of[back] = path
    return back


def dropped(*tables: DataFrame | None) -> None:
    """Remove tables of :func:`written` that nothing reads any more; others are left alone."""
    for df in tables:
        path = None if df is None else _path_of.pop(df, None)
        if path:
            _delete(path)


def swept(spark: SparkSession) -> None:
    """Have the driver look for what nobody holds any more: until it does, the executors keep the files
    of past shuffles, also of tables that are long written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, to be joined by shuffling whatever its size is taken for: the planner estimates exploded
    rows, and arrays that a file holds compressed, at a fraction of their size in memory."""
    return df.hint("merge")


def _delete(path: str) -> None:
    spark = _made.pop(path, None)
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


@atexit.register
def _clean() -> None:
    for path in list(_made):
        _delete(path)
