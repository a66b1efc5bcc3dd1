"""K3, K4: report and payload sinks."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.fixed import REPORT_PROPERTY_CHARS


def outcome_report(df: DataFrame) -> DataFrame:
    """K3: one row per asset; the property text is cut to 56 characters (the report's column width)."""
    return df.select(
        "container_id", F.col("asset_id").alias("id"), "class", "before", "after", "bytes_in", "bytes_out", "fmt",
        "mode", F.substring("props", 1, REPORT_PROPERTY_CHARS).alias("props"))


def write_outcome_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists"):
    outcome_report(df).write.mode(mode).format(fmt).save(path)


def payload_order(df: DataFrame, files: int = None) -> DataFrame:
    """K4: payload rows in container order, original asset order inside. Range partitioning on
    (container, ord) keeps a hot container from landing in one task, and files follow the same order."""
    parts = [files] if files else []
    return df.repartitionByRange(*parts, "container_id", "ord").sortWithinPartitions("container_id", "ord")


def write_payloads(df: DataFrame, path: str, files: int = None, mode: str = "errorifexists"):
    payload_order(df, files).write.mode(mode).parquet(path)
