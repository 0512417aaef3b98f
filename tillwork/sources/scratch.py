"""Intermediate tables in the folder all executors share.

Operators that read one intermediate result several times, or that need it to
stay fixed between two reads, write it once here. A written table survives
lost executors and has no lineage behind it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made, but only for a
    local master: on a cluster the executors would not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="tillwork-")
    return _own_folder[app]


def application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tillwork-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one intermediate table or stream checkpoint."""
    path = f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(build: Callable[[], DataFrame], label: str) -> DataFrame:
    """``materialise`` the frame that ``build`` makes, and delete the tables made on the way.

    For results that are small beside what they took; one at a time.
    """
    before = len(_made)
    result = materialise(build(), label)
    for path in _made[before:-1]:
        _delete(result.sparkSession, path)
    del _made[before:-1]
    return result


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application."""
    _delete(spark, application_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
