"""Tables written once and read again: later steps don't compute them anew, and a lost executor loses nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this machine, by application, where the session names no shared one (tests).
LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines of the cluster see; a folder of this machine only where `spark.checkpoint.dir` is unset."""
    name = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    return (name or LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="engine-"))).rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    path = fresh(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
