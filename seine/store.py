"""Tables that cut lineage and outlive executors.

`durable` writes a DataFrame as Parquet below the folder that the cluster shares
(`spark.checkpoint.dir`) and returns it reread.  A lost executor then costs a reread,
not a recomputation, and plans stay short in iterative operators.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only in local mode with none set."""
    root = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="seine-")
        spark.conf.set(_KEY, root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone at exit
        pass


_FOLDERS: set[str] = set()


def _app_folder(spark: SparkSession) -> str:
    folder = f"{shared_root(spark)}/seine-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, spark, folder)
    return folder


_WRITTEN: list[str] = []


def written() -> int:
    """How many tables `durable` has begun so far, for `release_since`."""
    return len(_WRITTEN)


def release_since(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Delete the tables written since `written()` gave `mark`, but for `keep` and those that are `stored`."""
    kept = {getattr(df, "_seine_path", None) for df in (keep, *_STORED.values())}
    for path in _WRITTEN[mark:]:
        if path not in kept:
            _delete(spark, path)
    _WRITTEN[mark:] = [p for p in _WRITTEN[mark:] if p in kept]


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared folder; removed when the driver ends."""
    return f"{_app_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below the shared folder and return it reread; removed when the driver ends."""
    spark = df.sparkSession
    path = f"{_app_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._seine_path = path
    return back


_STORED: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, name: str, source: str, build) -> DataFrame:
    """What build() gives, written once for `source` (a path) as it is now, and reread by every later call.

    The files' times and sizes are part of the key: a changed source is built anew.
    """
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(source)
    state = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    key = (spark.sparkContext.applicationId, name, source, state.getModificationTime(), state.getLen())
    if key not in _STORED:
        _STORED[key] = durable(build(), name)
    return _STORED[key]


def release(df: DataFrame) -> None:
    """Delete the files of a table made by `durable` that nothing reads any more."""
    path = getattr(df, "_seine_path", None)
    if path:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that `durable` has written in this application; results not yet read are lost."""
    _delete(spark, _app_folder(spark))
    _STORED.clear()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
