"""Connected components by alternating large-star and small-star."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import materialise


def _state(edges):
    r = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return r[0], int(r[1])


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) to (id, component), the smallest id reachable, for every id on an edge.

    Each step is one aggregate and one join; the edges are written to the shared folder after each pair of steps, and
    only a count and a checksum come to the driver. Loops, repeated edges and either direction are allowed; rows with a
    null end are no edges; without edges the result is empty.
    """
    e = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(e)
    while before[0]:
        # large-star: neighbours above u are hung on the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and its neighbours below are hung on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    tops = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return tops.unionByName(e.select(F.col("u").alias("id"), F.col("v").alias("component")))
