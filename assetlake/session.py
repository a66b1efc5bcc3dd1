"""Session defaults and lineage cutting."""
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What a cluster session for this library should set; a test session overrides the sizes.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # building large expressions from Python is much faster without a call site per operation
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # collect_set of owner keys stays hash-based up to this many groups per task
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def build(app="assetlake", master=None, shuffle_partitions=None, extra=None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**RECOMMENDED, **(extra or {})}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


_LOCAL_DIR = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset on a local master (tests), a
    temporary folder stands in; on a cluster an unset folder is an error, because a folder of one
    machine does not survive the loss of that machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _LOCAL_DIR[0]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: deterministic from here on, and an
    executor loss recomputes nothing above this point."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "assetlake-" + uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

