"""Working tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a table that
was written survives the loss of any executor. Outside a cluster, where the
setting is absent, a folder of the local machine is used (tests, local mode).
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from finquery.shared import shared_folder


@contextlib.contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session while a job runs."""
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: Rows that Spark's reader of Parquet holds at once, where nothing is set.
READER_ROWS = 4096
#: Writers look at their size after each of the first rows, not after a hundred: for tables whose rows have megabytes.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "8", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8"}


def small_batches(spark: SparkSession, rows: int = 1000) -> contextlib.AbstractContextManager[None]:
    """Batches out of files, to and from Python of so many rows while a job runs: whole texts in batches of 10,000 rows take too much memory."""
    return held(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.parquet.columnarReaderBatchSize": str(min(rows, READER_ROWS))})


def shuffles_removed(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Shuffle files of a job go when it ends: else they stay until the driver happens to collect its garbage, and all of a large run lie on disk at once."""
    return held(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


@contextlib.contextmanager
def cleared() -> Iterator[None]:
    """What operators that are called here write goes at the end; a table that is to stay belongs to a `Scratch` made before."""
    before = len(made)
    try:
        yield
    finally:
        for work in made[before:]:
            work.remove()
        del made[before:]


#: Those of the session that still have their tables.
made: list[Scratch] = []


class Scratch:
    """Tables of one operator call, below a folder of its own; removed when the session's process ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.catalogued: list[str] = []
        self.root = f"{shared_folder(spark)}/finquery-{label}-{uuid.uuid4().hex}"
        made.append(self)
        atexit.register(self.remove)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame, *partition: str, batch: int = 1000, **options: object) -> DataFrame:
        """Write ``df`` and return the written table. ``batch``: rows that are read, and go to Python, at once."""
        writer = df.write.mode("overwrite").options(compression="zstd", **options)
        with small_batches(self.spark, batch), shuffles_removed(self.spark):
            (writer.partitionBy(*partition) if partition else writer).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def remove(self, name: str = "") -> None:
        """Delete one table, or all of them."""
        if not name:
            atexit.unregister(self.remove)
        try:
            for table in [] if name else self.catalogued:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: the folder stays, as a checkpoint folder would
            if name:
                raise


def with_columns_of(df: DataFrame, **needed: str) -> DataFrame:
    """Only the named columns, cast to the given types; others, whatever their names, are left behind."""
    return df.select(*(df[f"`{c}`"].cast(kind).alias(c) for c, kind in needed.items()))
