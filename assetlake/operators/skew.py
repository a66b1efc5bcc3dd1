"""Joins on a key that a large part of the rows may share: frequent keys are found by a sketch and dealt over salts."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACKED = 1024  # keys that the sketch follows; any key with more than 1 / 768 of the rows is among them
KEPT = 512


def frequent_keys(df: DataFrame, by, parts: int) -> DataFrame:
    """(_hot, _salts): keys (as 64-bit hashes) that hold more than a quarter of a task's even share of the rows, and how many
    pieces they are cut into. At most ``KEPT`` rows, whatever the table.

    The frequent-items sketch counts in the task and merges (one small row a task). Its counts are estimates; a key it
    misses or adds costs balance, never a result."""
    items = df.select(F.xxhash64(*by).alias("item"))
    n = items.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(item, {KEPT}, {TRACKED})").alias("top"))
    top = n.select("n", F.inline("top").alias("_hot", "c"))
    salts = F.least(F.ceil(F.col("c") * (4 * parts) / F.col("n")), F.lit(4 * parts)).cast("int")
    return top.select("_hot", salts.alias("_salts")).where("_salts > 1")


def salted_join(many: DataFrame, few: DataFrame, by, spread) -> DataFrame:
    """Inner join on the columns ``by``, exact whatever the keys. Rows of a frequent key of ``many`` are dealt over salts by
    the columns ``spread``; the rows of ``few`` with that key are repeated for each salt. Rare keys join plainly.

    The table of frequent keys is broadcast; ``frequent_keys`` bounds it."""
    parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(frequent_keys(many, by, parts))
    m = many.withColumn("_key", F.xxhash64(*by)).join(hot, F.col("_key") == F.col("_hot"), "left")
    m = m.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int"), F.lit(0))).drop("_key", "_hot", "_salts")
    f = few.withColumn("_key", F.xxhash64(*by)).join(hot, F.col("_key") == F.col("_hot"), "left")
    f = f.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_key", "_hot", "_salts")
    return m.join(f, [*by, "_salt"]).drop("_salt")
