"""Tables of intermediate results in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_open_scratches: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset in local mode.
    On a cluster there is no folder that all see but a named one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="foliate-")
        context.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    for held in _open_scratches:
        held.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what operators have written to the shared folder within it; results that read it must have been
    written elsewhere by then."""
    held: list[str] = []
    _open_scratches.append(held)
    try:
        yield
    finally:
        _open_scratches.remove(held)
        for path in held:
            delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
