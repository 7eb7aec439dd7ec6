"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; where it is unset in local mode, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'finquery-shared')}"


def written(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` as a table in the shared folder, so that what is read several times is computed once; removed when the session's process ends."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/finquery-{label}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)

    def remove() -> None:
        with contextlib.suppress(Exception):  # the session has ended: the folder stays, as a checkpoint folder would
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    atexit.register(remove)
    return spark.read.schema(rows.schema).parquet(path)
