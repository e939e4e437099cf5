"""Tables that jobs keep between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in a local session that has none set, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob is there, in whatever file system it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where))


def small_text(spark: SparkSession, path: str) -> str:
    """A settings file's text, read by the driver through Hadoop's file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_FOLDER = "_step_folder"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a table of the shared folder: a later step reads it even if executors are lost."""
    path = scratch(df.sparkSession, "step")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    setattr(out, _FOLDER, path)
    return out


def forget(*steps: DataFrame) -> None:
    """Deletes ``checkpointed`` tables that nothing will read again."""
    for step in steps:
        if path := getattr(step, _FOLDER, None):
            where = step.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(step.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Writes a table's next state beside the present one and reads it; a path that is being read is never overwritten."""
    where = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
