"""Registry: name -> (callable on views, oracle SQL)."""
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from assetlake.registry.views import CTES, Views
from assetlake.session import cut_lineage

QUERIES, ORACLES = {}, {}


def with_views(sql: str) -> str:
    """Prepend the stand-in views a statement uses (and those they use) as common table expressions."""
    need, queue = [], re.findall(r"\bV_\w+", sql)
    while queue:
        n = queue.pop(0)
        if n in CTES:
            if n in need:
                need.remove(n)
            need.insert(0, n)
            queue += re.findall(r"\bV_\w+", CTES[n])
    if not need:
        return sql
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in need)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def with_place(df, *keys):
    """Adds the place of each row in the order the rows come in, equal for rows with equal ``keys``: a query that lost its
    order then differs from its oracle. For checks only: the rows are written once with their partition and position, then
    numbered by the running counts of the partitions."""
    n = cut_lineage(df.withColumn("_m", F.monotonically_increasing_id()))
    part, position = F.shiftrightunsigned("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = n.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))  # one row a partition
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("_p", part).join(sizes.select("_p", before.alias("_b")), "_p").withColumn("_n", position + F.col("_b") + 1)
    return n.withColumn("place", F.min("_n").over(Window.partitionBy(*keys)).cast("long")).drop("_m", "_n", "_p", "_b")


def query(name: str, sql: str = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError("duplicate query " + name)
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        QUERIES[name].__name__ = name
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return wrap
