"""Tables that a query writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder in local mode (tests); a cluster has to name one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A folder of its own in the shared one; a plain path where that is on a file system that the driver sees."""
    at = f"{shared_dir(spark).removeprefix('file://')}/{name}-{uuid.uuid4().hex}"
    if "://" not in at:
        os.makedirs(at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors. What shuffles have left on disk
    is of no more use then; it goes when the driver collects its garbage, so that is asked for here. Columns without a
    type, which Parquet lacks, come back as nulls."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    typed = df.drop(*(c for c, t in df.dtypes if t == "void"))
    typed.write.parquet(at)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(typed.schema).parquet(at)
    if len(typed.columns) < len(df.columns):
        out = out.select(*(F.lit(None).alias(c) if t == "void" else F.col(f"`{c}`") for c, t in df.dtypes))
    out._written_at = at
    return out


def spent(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
