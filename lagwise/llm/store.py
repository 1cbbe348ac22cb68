"""Intermediate tables as Parquet in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, ship_package

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 1000  #: texts that cross to a Python worker at once, at most


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def map_arrow(df: DataFrame, job, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors' path."""
    ship_package(df.sparkSession)
    return df.mapInArrow(job, schema)


def map_groups(grouped, job, schema: str, spark: SparkSession) -> DataFrame:
    """``grouped.applyInPandas`` with this package on the executors' path."""
    ship_package(spark)
    return grouped.applyInPandas(job, schema)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the queries run inside, put back afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def text_batches(spark: SparkSession):
    """Queries run inside send whole texts to Python by ``TEXT_ROWS`` at most: a batch is held by the JVM and by its worker."""
    now = int(spark.conf.get(BATCH_ROWS, "10000"))
    return setting(spark, BATCH_ROWS, str(min(now, TEXT_ROWS) if now > 0 else TEXT_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: cuts the lineage, survives lost executors.

    The shuffle files of the write are freed as soon as it ends (a setting of the session, put back afterwards), not when
    the driver happens to collect its garbage: nothing reads them again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with setting(spark, FREE_SHUFFLES, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        base = checkpoint_dir(spark).rstrip("/").split(":", 1)[-1].lstrip("/")
        for folder in folders:
            if base in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
