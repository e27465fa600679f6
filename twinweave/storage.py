"""Tables and intermediate results in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made for local sessions that name none, by application.
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where a session names none, one that runs on a single machine gets a temporary folder; on a cluster
    executors couldn't see that, so it is an error there.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="twinweave-")
    return _OWN[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def removed(*frames: DataFrame) -> None:
    """Deletes what written() made, once nothing reads it any more."""
    for df in frames:
        spark, path = df.sparkSession, df._written_at
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def shuffles_released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now: it does so once the driver has collected what
    referred to them, which jobs of many rounds would otherwise wait for while their files pile up."""
    gc.collect()
    spark._jvm.System.gc()
