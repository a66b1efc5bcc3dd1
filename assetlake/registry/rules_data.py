"""Stand-in plans and preset rules derived from the given tables."""
from pyspark.sql import functions as F

from assetlake.functions.classify import class_at, class_ord, property_rank
from assetlake.functions.rules import rule
from assetlake.functions.text import signature
from assetlake.operators.resolve import builtin_plans
from assetlake.registry import sqltext as T
from assetlake.registry.views import _PROP_SQL, property_of_part

# one preset per brand; one asset rule per part: its signatures are (slot 1, part name) and (slot 2, part name)
# for large parts, none for small ones; the id is the part key
ASSET_RULES_SQL = f"""SELECT p_brand AS preset_id, CAST(p_partkey AS INT) AS rule_no, CAST(p_partkey AS VARCHAR) AS asset_id,
  CASE WHEN p_size > 20 THEN [{T.sig('1', 'p_name', _PROP_SQL)}, {T.sig('2', 'p_name', _PROP_SQL)}] ELSE [] END AS sigs,
  CASE p_type WHEN 'PROMO' THEN 'jpeg' WHEN 'LARGE' THEN 'png' WHEN 'SMALL' THEN 'keep' ELSE 'auto' END AS format,
  p_size * 16 AS size FROM part"""


def asset_rules(v):
    t = F.col("p_type")
    fmt = F.when(t == "PROMO", "jpeg").when(t == "LARGE", "png").when(t == "SMALL", "keep").otherwise("auto")
    sigs = F.array(*[signature(F.lit(s), F.col("p_name"), property_of_part()) for s in (1, 2)])
    return v.part.select(
        F.col("p_brand").alias("preset_id"), F.col("p_partkey").cast("int").alias("rule_no"),
        F.col("p_partkey").cast("string").alias("asset_id"),
        F.when(F.col("p_size") > 20, sigs).otherwise(F.array().cast("array<string>")).alias("sigs"),
        rule(fmt, F.col("p_size") * 16).alias("rule"))


def plan_quality(v):
    return builtin_plans(v.spark).where("plan_id = 'quality'").drop("plan_id")


# one plan per brand: a class is changed when the brand has a large enough part of it
PLANS_SQL = f"""SELECT p_brand AS plan_id, {T.class_at(T.class_rank(_PROP_SQL))} AS class,
  CASE WHEN max(p_size) >= 46 THEN 'auto' ELSE 'keep' END AS format,
  CASE WHEN max(p_size) >= 49 THEN max(p_size) * 20 ELSE 0 END AS size FROM part GROUP BY 1, 2"""


def brand_plans(v):
    cls = class_at(property_rank(property_of_part()))
    per = v.part.groupBy(F.col("p_brand").alias("plan_id"), cls.alias("class")).agg(F.max("p_size").alias("m"))
    m = F.col("m")
    return per.select("plan_id", "class", class_ord(F.col("class")).alias("ord"),
                      rule(F.when(m >= 46, "auto").otherwise("keep"), F.when(m >= 49, m * 20).otherwise(0)).alias("rule"))


# which preset runs on which container: the brand that carries the number of the supplier's nation
RUNS_SQL = "SELECT s_suppkey AS container_id, 'Brand#' || (s_nationkey + 1) AS preset_id FROM supplier"


def runs(v):
    return v.supplier.select(F.col("s_suppkey").alias("container_id"),
                             F.concat(F.lit("Brand#"), F.col("s_nationkey") + 1).alias("preset_id"))


# J8 hits of those runs
HITS_SQL = f"""ar AS ({ASSET_RULES_SQL}), runs AS ({RUNS_SQL}), rs AS (SELECT preset_id, rule_no, format, size, unnest(sigs) AS sig FROM ar),
hits AS (SELECT container_id, asset_id, preset_id, rule_no, format, size FROM V_asset_sigs JOIN runs USING (container_id) JOIN rs USING (sig, preset_id)
  UNION SELECT a.container_id, a.asset_id, preset_id, rule_no, format, size FROM V_assets a JOIN runs USING (container_id)
  JOIN ar USING (preset_id) LEFT JOIN (SELECT DISTINCT container_id, asset_id, true AS bound FROM V_asset_sigs) b
  ON a.container_id = b.container_id AND a.asset_id = b.asset_id
  WHERE CAST(a.asset_id AS VARCHAR) = ar.asset_id AND (len(ar.sigs) = 0 OR bound IS NULL))"""
