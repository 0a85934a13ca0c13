"""Session helpers: shared checkpoint folder, staged tables, fresh column names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master without that setting gets
    a temporary folder; elsewhere a missing setting is an error, since executors would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="strandex-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; what is written there is removed when the Python process ends."""
    path = f"{shared_dir(spark)}/strandex-stage/{label}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_sweep)
    _staged.append(path)
    return path


def stage(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    This cuts lineage and survives lost executors; the planner then knows the table's size.
    Staged tables are removed when the Python process ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Remove a table made by :func:`stage` once nothing reads it any more."""
    for name in df.inputFiles()[:1]:
        _delete(df.sparkSession, name.rsplit("/", 1)[0])


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _staged:
        _staged.remove(path)


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in list(_staged):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may already be gone at interpreter exit
            return


def fresh(df: DataFrame, name: str) -> str:
    """A column name starting with ``name`` that ``df`` does not have (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
