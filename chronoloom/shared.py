"""Tables and folders that every executor and the driver can reach.

Intermediate results are cut from their lineage by writing them to the folder
named in ``spark.checkpoint.dir``. Files there survive lost executors. Where the
setting is absent and Spark runs in one process (tests, notebooks) a folder under the
system's temporary directory is used instead; on a cluster that is an error, because
every executor would write to its own disk. What is left of the tables when the session
ends is deleted.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or an own one where none is configured and none is needed."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="chronoloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder; what is written there is deleted when the session ends, if not before."""
    if not _written:
        atexit.register(_forget_all)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result has no lineage, exact sizes for the planner and no inherited
    partitioning.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Delete the files behind materialised tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._written_to)
        _written.pop(table._written_to, None)


def _forget_all() -> None:
    for path, spark in _written.items():
        if spark.sparkContext._jsc is None:
            return  # the session has ended before the process
        _delete(spark, path)
