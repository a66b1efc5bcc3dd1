"""Q1-Q6 on the given tables."""
from pyspark.sql import functions as F

from assetlake.operators.resolve import builtin_plans
from assetlake.plans import reports as R
from assetlake.registry import sqltext as T
from assetlake.registry.core import query
from assetlake.registry.q_rules import MERGED
from assetlake.registry.rules_data import plan_quality


def _inv(v):
    return {"assets": v.assets, "bindings": v.bindings}


@query("Q1_scan_report", f"""
SELECT 'container' AS scope, CAST(container_id AS VARCHAR) AS container_id, class, n_assets, n_bytes, max_dim, {T.human('n_bytes')} AS shown FROM V_class_stats UNION ALL
SELECT 'corpus', NULL, class, n_assets, n_bytes, max_dim, {T.human('n_bytes')} FROM (SELECT coalesce(class, 'total') AS class,
  CAST(sum(n_assets) AS BIGINT) AS n_assets, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, max(max_dim) AS max_dim FROM V_class_stats GROUP BY ROLLUP (class))""")
def q1(v):
    from assetlake.functions.text import human_bytes
    rep = R.scan_report(_inv(v))
    cols = ["scope", "container_id", "class", "n_assets", "n_bytes", "max_dim"]
    a = rep["stats"].withColumn("scope", F.lit("container")).withColumn("container_id", F.col("container_id").cast("string"))
    b = rep["totals"].withColumn("scope", F.lit("corpus")).withColumn("container_id", F.lit(None).cast("string"))
    return a.select(*cols).unionByName(b.select(*cols)).withColumn("shown", human_bytes(F.col("n_bytes")))


_DOMAIN = """(SELECT container_id, owner_key FROM V_parts UNION
  SELECT container_id, unnest(range(9))::INT FROM (SELECT DISTINCT container_id FROM V_assets))"""
_ORPHANS = """(SELECT container_id, count(*) AS n, CAST(sum(n_bytes) AS BIGINT) AS b FROM (SELECT * FROM V_assets ANTI JOIN V_bindings
  USING (container_id, asset_id)) GROUP BY 1)"""


@query("Q2_parts_report", f"""
SELECT d.container_id, d.owner_key, {T.owner_name('d.owner_key')} AS owner_name, coalesce(p.n_assets, 0) AS n_assets, coalesce(p.n_bytes, 0) AS n_bytes,
  coalesce(p.own_count, 0) AS own_count, coalesce(p.own_bytes, 0) AS own_bytes, coalesce(o.n, 0) AS n_orphans, coalesce(o.b, 0) AS orphan_bytes
FROM {_DOMAIN} d LEFT JOIN V_parts p USING (container_id, owner_key) LEFT JOIN {_ORPHANS} o ON o.container_id = d.container_id""")
def q2(v):
    return R.parts_report(_inv(v))


@query("Q3_group_report", f"""
SELECT container_id, owner_key // 100000 - 1 AS group_no, 'part' AS level, owner_key, CAST(1 AS BIGINT) AS n_parts, n_assets, n_bytes FROM V_gparts UNION ALL
SELECT container_id, owner_key // 100000 - 1, 'group', NULL, count(*), CAST(sum(n_assets) AS BIGINT), CAST(sum(n_bytes) AS BIGINT) FROM V_gparts GROUP BY 1, 2
UNION ALL SELECT container_id, NULL, 'orphans', NULL, 0, n, b FROM {_ORPHANS}""")
def q3(v):
    return R.group_report({"assets": v.assets, "bindings": v.gbindings})


@query("Q4_plan_corpus", f"""
WITH {MERGED},
r AS (SELECT a.container_id, a.asset_id, a.class, a.width, a.height, a.flat_alpha, a.circle_only, coalesce(k.risky, false) AS risky,
  coalesce(k.n_owners = 1, false) AS exclusive, m.k IS NULL OR m.n_off > 0 AS keep, CASE WHEN m.n_off = 0 THEN m.format ELSE 'auto' END AS format,
  CASE WHEN m.n_off = 0 THEN m.size ELSE CASE a.class WHEN 'maintex' THEN 2048 ELSE 1024 END END AS size, CASE WHEN m.n_off = 0 THEN m.up END AS up,
  CASE WHEN m.k IS NULL THEN 'no owner' WHEN m.n_off > 0 THEN 'left alone by ' || m.off_keys WHEN m.k > 1 THEN 'shared by its owners' END AS reason
  FROM V_classed a LEFT JOIN merged m USING (container_id, asset_id) LEFT JOIN V_asset_class k USING (container_id, asset_id)),
f AS (SELECT *, CASE format WHEN 'jpeg' THEN true WHEN 'png' THEN false ELSE (flat_alpha OR (class = 'matcap' AND circle_only)) AND NOT risky END AS use_jpeg,
  CASE WHEN size > 0 THEN size ELSE greatest(width, height) END AS cap0 FROM r),
c AS (SELECT *, exclusive AND NOT keep AND 4096 > cap0 AS protected, CASE WHEN exclusive AND NOT keep THEN greatest(4096, cap0) ELSE cap0 END AS cap FROM f),
u AS (SELECT *, CASE WHEN coalesce(up, 2) <= 1 OR class IN ('normal', 'mask', 'height') THEN 0
  WHEN greatest(width, height) * coalesce(up, 2) <= least(cap, 4096) THEN coalesce(up, 2)
  WHEN coalesce(up, 2) >= 4 AND greatest(width, height) * 2 <= least(cap, 4096) THEN 2 ELSE 0 END AS up_factor FROM c)
SELECT container_id, asset_id, class, keep, reason, use_jpeg, protected, cap, up_factor,
  CASE WHEN coalesce(up, 2) <= 1 THEN NULL WHEN class IN ('normal', 'mask', 'height') THEN 'data' WHEN up_factor = 0 THEN 'cap' END AS up_reason,
  CAST(CASE WHEN up_factor > 1 THEN width * up_factor WHEN greatest(width, height) > cap THEN greatest(1, round_even(width * (cap::DOUBLE / greatest(width, height)), 0)) ELSE width END AS INT) AS target_width,
  CAST(CASE WHEN up_factor > 1 THEN height * up_factor WHEN greatest(width, height) > cap THEN greatest(1, round_even(height * (cap::DOUBLE / greatest(width, height)), 0)) ELSE height END AS INT) AS target_height
FROM u""")
def q4(v):
    df = R.plan_corpus(_inv(v), plan_quality(v), v.owner_rules, up=2)
    return df.select("container_id", "asset_id", "class", "keep", "reason", "use_jpeg", "protected", "cap", "up_factor", "up_reason",
                     "target_width", "target_height")


_Q5 = """co AS (SELECT c.container_id, CASE WHEN rc = 6 AND priority < '3' THEN 4 ELSE rc END AS rc, rc = 0 AND priority = '2-HIGH' AS copied,
  n_bytes_before > 2000000 AS verified, n_bytes_before * 100 AS bytes_before,
  n_bytes_before * 100 - coalesce(gain, 0) AS bytes_after FROM V_containers c LEFT JOIN (
    SELECT container_id, CAST(sum(raw_bytes - out_bytes) AS BIGINT) AS gain FROM V_outcomes GROUP BY 1) g USING (container_id))"""


@query("Q5_summarise", f"""
WITH {_Q5} SELECT *, round(100.0::DOUBLE * bytes_after / greatest(bytes_before, 1), 6) AS pct FROM (SELECT
  count(*) FILTER (WHERE rc = 0 AND NOT copied AND verified) AS n_ok, count(*) FILTER (WHERE rc IN (3, 6)) AS n_skipped,
  count(*) FILTER (WHERE rc NOT IN (0, 3, 6) OR (rc = 0 AND NOT copied AND NOT verified)) AS n_failed,
  count(*) FILTER (WHERE rc = 0 AND copied) AS n_copied, CAST(sum(bytes_before) FILTER (WHERE rc = 0 AND NOT copied) AS BIGINT) AS bytes_before,
  CAST(sum(bytes_after) FILTER (WHERE rc = 0 AND NOT copied) AS BIGINT) AS bytes_after FROM co)""")
def q5(v):
    rc = F.when((F.col("rc") == 6) & (F.col("priority") < "3"), 4).otherwise(F.col("rc"))
    c = v.containers.select("container_id", rc.alias("rc"), ((F.col("rc") == 0) & (F.col("priority") == "2-HIGH")).alias("copied"),
                            (F.col("n_bytes_before") > 2000000).alias("verified"), F.lit("").alias("reason"),
                            (F.col("n_bytes_before") * 100).alias("bytes_before"))
    return R.summarise(v.candidates, c)["batch"].withColumn("pct", F.round("pct", 6))


_PLANS = ["optimise", "performance", "quality"]


@query("Q6_compare_plans", """
WITH p(plan_id, m, r) AS (VALUES ('optimise', 0, 0), ('performance', 1024, 512), ('quality', 2048, 1024)),
x AS (SELECT a.class, plan_id, a.n_bytes, width, height, CASE WHEN coalesce(k.n_owners = 1, false) THEN greatest(4096, cap0) ELSE cap0 END AS cap FROM (
  SELECT c.*, plan_id, CASE WHEN (CASE class WHEN 'maintex' THEN m ELSE r END) > 0 THEN (CASE class WHEN 'maintex' THEN m ELSE r END)
    ELSE greatest(width, height) END AS cap0 FROM V_classed c CROSS JOIN p) a LEFT JOIN V_asset_class k USING (container_id, asset_id)),
t AS (SELECT *, CASE WHEN greatest(width, height) > cap THEN cap::DOUBLE / greatest(width, height) ELSE 1.0 END AS sc FROM x),
s AS (SELECT class, plan_id, least(CAST(floor(n_bytes * ((CAST(greatest(1, round_even(width * sc, 0)) AS BIGINT) * CAST(greatest(1, round_even(height * sc, 0)) AS BIGINT))::DOUBLE
  / greatest(width * height, 1))) AS BIGINT), n_bytes) AS b FROM t)
SELECT class, count(*) FILTER (WHERE plan_id = 'optimise') AS optimise_changed, CAST(sum(b) FILTER (WHERE plan_id = 'optimise') AS BIGINT) AS optimise_bytes_after,
  count(*) FILTER (WHERE plan_id = 'performance') AS performance_changed, CAST(sum(b) FILTER (WHERE plan_id = 'performance') AS BIGINT) AS performance_bytes_after,
  count(*) FILTER (WHERE plan_id = 'quality') AS quality_changed, CAST(sum(b) FILTER (WHERE plan_id = 'quality') AS BIGINT) AS quality_bytes_after FROM s GROUP BY 1""")
def q6(v):
    plans = builtin_plans(v.spark).where(F.col("plan_id").isin(*_PLANS))
    return R.compare_plans(_inv(v), plans, _PLANS)
