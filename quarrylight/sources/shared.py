"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application's own in the one that the driver and all executors share.

    ``spark.checkpoint.dir`` names that. Only a session on a local master may go
    without: it then gets a temporary folder. What is in the folder goes when the driver's JVM ends.
    """
    context = spark.sparkContext
    made = getattr(context, "_quarrylight_shared", None)
    if made is not None:
        return made
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quarrylight-")
    made = f"{base}/quarrylight-{context.applicationId}-{uuid.uuid4().hex[:8]}"
    path = context._jvm.org.apache.hadoop.fs.Path(made)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    context._quarrylight_shared = made
    return made


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt to all cores by ``key``: for work that takes far longer than reading, since a small file is one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    It cuts lineage and keeps costly columns from being computed twice, and the
    files outlive lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that ``settled`` gave and that nobody reads any more, such as the last round's of an iteration."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"{shared_dir(spark).removeprefix('file:').lstrip('/')}/" in file:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
