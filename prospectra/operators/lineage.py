"""Tables that end a lineage: written to the folder that driver and executors share, read back, and deleted when done."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``; only a local session may have none and gets one beside the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cut"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: nothing before it is computed again, also after the loss of an executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete cut tables that nothing will read again."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
