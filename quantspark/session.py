"""Session defaults."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quantspark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` adds settings (dots as double underscores)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors see: the cluster's checkpoint folder, or where none is set (tests) our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read again: made once however often it is read, whatever executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
