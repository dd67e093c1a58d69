"""Intermediate tables in the folder that driver and executors share, for loops whose plans would grow."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where tables go on one machine whose session names no shared folder.
LOCAL = "/tmp/checkpoints/stratamesh"
_open: dict[str, SparkSession] = {}


def stage_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Without that setting, a folder of this machine if all of Spark runs in one process on it; RuntimeError on a cluster,
    where every executor would write to a disk of its own and the driver would read what it happens to see.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL).rstrip("/")


def _remove(path: str) -> None:
    spark = _open.pop(path, None)
    with contextlib.suppress(Exception):  # the session may be gone
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stage_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder for files, deleted when the process ends."""
    path = f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _open[path] = spark
    return path


def mounted(path: str) -> str:
    """The path as the file system of driver and executors has it; ValueError for stores that aren't mounted."""
    scheme, _, rest = path.partition(":") if ":" in path.split("/")[0] else ("file", "", path)
    if scheme != "file":
        raise ValueError(f"not a mounted folder: {path}")
    return "/" + rest.lstrip("/") if rest.startswith("/") else rest


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lost executors lose none of it. It goes with unstage(), or when the process ends."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Deletes staged tables that nobody reads any more. Other frames are let be."""
    for df in frames:
        path = vars(df).get("staged_at")
        if path in _open:
            _remove(path)


@atexit.register
def _remove_all() -> None:
    for path in list(_open):
        _remove(path)
