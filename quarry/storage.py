"""Tables in the folder that the driver and all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

MARK = "quarry-"
#: Whether Spark deletes the shuffle files of a query when it ends, not when the driver's garbage is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session gets a temporary folder; a cluster has none that all executors see, so that is an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    conf = "file://" + tempfile.mkdtemp(prefix=MARK)
    spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, without the shuffle files that made it. Delete it with discard() when nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{MARK}{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame | None) -> None:
    """Deletes the tables behind frames that materialize() returned; other inputs of a frame stay."""
    for df in frames:
        if df is None:
            continue
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if name.rsplit("/", 1)[-1].startswith(MARK):
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
