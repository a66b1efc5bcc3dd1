"""J1-J14 and X1-X3 on the given tables."""
from pyspark.sql import functions as F

from assetlake.functions import text
from assetlake.operators import assets as A
from assetlake.operators import facts as FT
from assetlake.operators import presets as P
from assetlake.operators import summaries as S
from assetlake.operators.outcomes import compare_results
from assetlake.operators.resolve import clear_overrides, literal_rows, rules_by_class
from assetlake.registry import sqltext as T
from assetlake.registry.core import query
from assetlake.registry.rules_data import ASSET_RULES_SQL, HITS_SQL, asset_rules, plan_quality, runs
from assetlake.schemas import RULE
from assetlake.session import cut_lineage


@query("J1_with_props", """
SELECT a.container_id, a.asset_id, coalesce(p.props, '-') AS props FROM V_assets a LEFT JOIN (
  SELECT container_id, asset_id, array_to_string(list_sort(list_distinct(list(property))), ',') AS props
  FROM V_bindings GROUP BY ALL) p USING (container_id, asset_id)""")
def j1(v):
    return A.with_props(v.assets, v.bindings).select("container_id", "asset_id", text.props_text(F.col("props")).alias("props"))


@query("J2_orphans", """
SELECT container_id, asset_id, n_bytes FROM V_assets ANTI JOIN V_bindings USING (container_id, asset_id)""")
def j2(v):
    return A.orphans(v.assets, v.bindings).select("container_id", "asset_id", "n_bytes")


_J3 = f"""asset_shaders AS (SELECT DISTINCT b.container_id, b.asset_id, s.shader FROM V_bindings b JOIN (
  SELECT container_id, owner_key, material, min_by(shader, (ord, shader)) AS shader FROM (
    SELECT container_id, ord, shader, material, CASE WHEN obj_type = 2 THEN 1000 + slot WHEN obj_type >= 3 THEN 2000 + slot
      ELSE slot END AS owner_key FROM V_shaders) GROUP BY ALL) s
  ON b.container_id = s.container_id AND b.owner_key = s.owner_key AND {T.norm_material('b.material')} = s.material
  WHERE s.shader <> '')"""


@query("J3_asset_shaders", f"WITH {_J3} SELECT * FROM asset_shaders")
def j3(v):
    return A.asset_shaders(v.bindings, v.shaders)


@query("J4_all_non_alpha", f"""WITH {_J3} SELECT a.container_id, a.asset_id, coalesce(s.ok, false) AS non_alpha FROM V_assets a
LEFT JOIN (SELECT container_id, asset_id, bool_and(NOT contains(lower(shader), 'alpha')) AS ok FROM asset_shaders GROUP BY ALL) s
USING (container_id, asset_id)""")
def j4(v):
    return A.all_non_alpha(v.assets, A.asset_shaders(v.bindings, v.shaders)).select("container_id", "asset_id", "non_alpha")


@query("J5_complete_owners", """
SELECT d.container_id, d.owner_key, coalesce(p.n_assets, 0) AS n_assets, coalesce(p.n_bytes, 0) AS n_bytes FROM (
  SELECT container_id, owner_key FROM V_parts UNION
  SELECT container_id, unnest(range(9))::INT FROM (SELECT DISTINCT container_id FROM V_assets)) d
LEFT JOIN V_parts p USING (container_id, owner_key)""")
def j5(v):
    full = S.complete_owners(S.part_summary(v.bindings, v.assets), v.assets)
    return full.select("container_id", "owner_key", "n_assets", "n_bytes")


@query("J5_complete_groups", """
SELECT d.container_id, d.owner_key, coalesce(p.n_assets, 0) AS n_assets, coalesce(p.n_bytes, 0) AS n_bytes FROM (
  SELECT container_id, owner_key FROM V_gparts UNION
  SELECT container_id, (unnest(range(8))::INT + 1) * 100000 FROM (SELECT DISTINCT container_id FROM V_assets)) d
LEFT JOIN V_gparts p USING (container_id, owner_key)""")
def j5b(v):
    full = S.complete_owners(S.part_summary(v.gbindings, v.assets), v.assets, grouped=True)
    return full.select("container_id", "owner_key", "n_assets", "n_bytes")


@query("J6_rules_by_class", """
SELECT container_id, asset_id, class, 'auto' AS format, CASE class WHEN 'maintex' THEN 2048 ELSE 1024 END AS size FROM V_classed""")
def j6(v):
    df = rules_by_class(S.classed(v.assets, v.bindings), plan_quality(v))
    return df.select("container_id", "asset_id", "class", F.col("class_rule.format").alias("format"),
                     F.col("class_rule.size").alias("size"))


@query("J6_own_classes", """
SELECT p_partkey, p_type, CASE p_type WHEN 'PROMO' THEN 'jpeg' WHEN 'LARGE' THEN 'keep' END AS format,
  CASE p_type WHEN 'PROMO' THEN 512 WHEN 'LARGE' THEN 0 END AS size FROM part""")
def j6_own(v):
    """A plan with classes of the caller's own."""
    plan = literal_rows(v.spark, [{"class": "PROMO", "rule": {"format": "jpeg", "size": 512}}, {"class": "LARGE", "rule": {"format": "keep", "size": 0}}],
                        f"class:string,rule:{RULE}")
    df = rules_by_class(v.part.select("p_partkey", "p_type", F.col("p_type").alias("class")), plan)
    return df.select("p_partkey", "p_type", F.col("class_rule.format").alias("format"), F.col("class_rule.size").alias("size"))


@query("J7_owner_rules", """
SELECT container_id, asset_id, ord, slot, owner_key, format, size FROM V_bindings LEFT JOIN V_owner_rules USING (owner_key)""")
def j7(v):
    j = A.with_owner_rule(v.bindings, v.owner_rules)
    return j.select("container_id", "asset_id", "ord", "slot", "owner_key", F.col("_r.format").alias("format"), F.col("_r.size").alias("size"))


@query("J8_match_asset_rules", f"WITH {HITS_SQL} SELECT container_id, asset_id, preset_id, rule_no FROM hits")
def j8(v):
    return FT.match_asset_rules(v.facts, asset_rules(v), runs(v))


@query("J9_missed_rules", f"""
WITH {HITS_SQL}, want AS (SELECT container_id, preset_id, rule_no, asset_id FROM runs JOIN ar USING (preset_id)),
used AS (SELECT DISTINCT container_id, CAST(asset_id AS VARCHAR) AS asset_id FROM hits),
seen AS (SELECT DISTINCT container_id, preset_id, rule_no FROM rs JOIN V_csigs USING (sig))
SELECT container_id, preset_id, rule_no FROM want ANTI JOIN used USING (container_id, asset_id) ANTI JOIN seen USING (container_id, preset_id, rule_no)""")
def j9(v):
    return FT.missed_rules(v.facts, asset_rules(v), runs(v))


@query("J9_missed_counts", f"""
WITH {HITS_SQL}, used AS (SELECT DISTINCT container_id, CAST(asset_id AS VARCHAR) AS asset_id FROM hits),
found AS (SELECT container_id, preset_id, rule_no FROM runs JOIN ar USING (preset_id) JOIN used USING (container_id, asset_id)
  UNION SELECT container_id, preset_id, rule_no FROM runs JOIN rs USING (preset_id) JOIN V_csigs USING (container_id, sig))
SELECT container_id, preset_id, n_rules, n_rules - coalesce(n, 0) AS n_missed FROM runs JOIN (SELECT preset_id, count(*) AS n_rules FROM ar GROUP BY 1) USING (preset_id)
LEFT JOIN (SELECT container_id, preset_id, count(*) AS n FROM found GROUP BY ALL) USING (container_id, preset_id)""")
def j9_counts(v):
    return FT.missed_counts(v.facts, asset_rules(v), runs(v))


@query("J10_match_score", """
SELECT preset_id, container_id, n_hits, n_sigs, round(n_hits / n_sigs, 9) AS score FROM (
  SELECT preset_id, container_id, count(*) AS n_hits FROM V_preset_sigs JOIN V_csigs USING (sig) GROUP BY ALL)
JOIN (SELECT preset_id, count(*) AS n_sigs FROM V_preset_sigs GROUP BY ALL) USING (preset_id)""")
def j10(v):
    out = P.match_score(v.preset_sigs, FT.fingerprint(v.facts))
    return out.withColumn("score", F.round("score", 9))


@query("J10_empty_presets", """
SELECT 'bare' || r_regionkey AS preset_id, s_suppkey AS container_id, CAST(0 AS BIGINT) AS n_hits, CAST(0 AS BIGINT) AS n_sigs,
  CAST(1.0 AS DOUBLE) AS score FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey
WHERE s_acctbal >= 3000""")
def j10_empty(v):
    """A preset without signatures fits every container of its directory and kind, and no other."""
    c = _places(v)
    p = v.region.select(F.concat(F.lit("bare"), "r_regionkey").alias("preset_id"), F.col("r_regionkey").alias("rel_dir"), F.lit("clothes").alias("kind"))
    return P.match_score(v.preset_sigs.where("preset_id = 'none'"), S.fingerprint(v.bindings), p, c)


def _places(v):
    return v.supplier.join(v.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("container_id"), F.col("n_regionkey").alias("rel_dir"),
        F.when(F.col("s_acctbal") < 3000, "chara").otherwise("clothes").alias("kind"), "s_acctbal")


# directory = region of the supplier, kind by its balance; in every directory and kind the container
# with the lowest balance is the one a preset was saved from
_J11_MIN = 0.3


@query("J11_similar_containers", f"""
WITH c AS (SELECT s_suppkey AS container_id, n_regionkey AS rel_dir, CASE WHEN s_acctbal < 3000 THEN 'chara' ELSE 'clothes' END AS kind, s_acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT rel_dir, kind, min_by(container_id, (s_acctbal, container_id)) AS preset_id FROM c GROUP BY ALL),
n AS (SELECT container_id AS preset_id, count(*) AS n_sigs FROM V_csigs GROUP BY ALL)
SELECT preset_id, container_id, n_hits, n_sigs, round(n_hits / n_sigs, 9) AS score FROM (
  SELECT p.preset_id, c.container_id, count(*) AS n_hits FROM p JOIN V_csigs sa ON sa.container_id = p.preset_id
  JOIN V_csigs sb ON sb.sig = sa.sig JOIN c ON c.container_id = sb.container_id AND c.rel_dir = p.rel_dir AND c.kind = p.kind GROUP BY ALL)
JOIN n USING (preset_id) WHERE n_hits >= ceil(n_sigs * {_J11_MIN} - 1e-9)""")
def j11(v):
    c = _places(v)
    p = c.groupBy("rel_dir", "kind").agg(F.min(F.struct("s_acctbal", "container_id")).alias("m")).select(
        F.col("m.container_id").alias("preset_id"), "rel_dir", "kind")
    p = cut_lineage(p)  # few rows, and known to be: signatures meet them where they lie
    sigs = FT.fingerprint(v.facts)
    own = sigs.withColumnRenamed("container_id", "preset_id").join(p.select("preset_id"), "preset_id", "left_semi")
    return P.similar_containers(p, own, c, sigs, _J11_MIN).withColumn("score", F.round("score", 9))


@query("J12_sharing_pairs", """
WITH o AS (SELECT DISTINCT container_id, asset_id, owner_key FROM V_bindings)
SELECT a.container_id, a.owner_key AS owner_a, b.owner_key AS owner_b, count(*) AS n_assets, CAST(sum(n_bytes) AS BIGINT) AS n_bytes
FROM o a JOIN o b USING (container_id, asset_id) JOIN V_assets USING (container_id, asset_id)
WHERE a.owner_key < b.owner_key GROUP BY ALL""")
def j12(v):
    return A.sharing_pairs(v.bindings, v.assets)


@query("J13_compare_results", """
SELECT o_orderkey, CASE WHEN r IS NULL THEN 'only_left' WHEN l IS NULL THEN 'only_right' WHEN n = 0 THEN 'same' ELSE 'changed' END AS status,
  CASE WHEN l AND r THEN n ELSE 0 END AS n_diff FROM (
  SELECT *, CASE WHEN a.o_custkey IS NOT DISTINCT FROM b.o_custkey THEN 0 ELSE 1 END
    + CASE WHEN a.price IS NOT DISTINCT FROM b.price THEN 0 ELSE 1 END
    + CASE WHEN sha256(a.o_orderpriority) IS NOT DISTINCT FROM sha256(b.o_orderpriority) THEN 0 ELSE 1 END AS n
  FROM (SELECT o_orderkey, o_custkey, o_totalprice AS price, o_orderpriority, true AS l FROM orders WHERE o_orderstatus <> 'P') a
  FULL JOIN (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 300000 THEN o_totalprice + 1 ELSE o_totalprice END AS price,
    CASE WHEN o_custkey < 20 THEN o_orderpriority || '!' ELSE o_orderpriority END AS o_orderpriority, true AS r FROM orders
    WHERE o_orderpriority <> '1-URGENT') b USING (o_orderkey))""")
def j13(v):
    o = v.orders
    left = o.where("o_orderstatus <> 'P'").withColumn("price", F.col("o_totalprice"))
    right = o.where("o_orderpriority <> '1-URGENT'").withColumn(
        "price", F.when(F.col("o_totalprice") > 300000, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    ).withColumn("o_orderpriority", F.when(F.col("o_custkey") < 20, F.concat("o_orderpriority", F.lit("!")))
                 .otherwise(F.col("o_orderpriority")))
    return compare_results(left, right, ["o_orderkey"], ["o_custkey", "price"], ["o_orderpriority"])


@query("J14_clear_overrides", """
SELECT container_id, asset_id FROM V_assets a WHERE p_type = 'ECONOMY' AND NOT EXISTS (SELECT 1 FROM V_gbindings b
  WHERE b.container_id = a.container_id AND b.asset_id = a.asset_id AND b.group_no = 0)""")
def j14(v):
    from assetlake.functions.keys import key_group
    ov = v.assets.where("p_type = 'ECONOMY'").select("container_id", "asset_id")
    return clear_overrides(ov, v.gbindings, key_group(F.col("owner_key")) == 0)


@query("X1_all_sigs", f"""
WITH ar AS ({ASSET_RULES_SQL}), stored AS (SELECT DISTINCT preset_id, sig FROM V_preset_sigs WHERE preset_id < 'Brand#2')
SELECT * FROM stored UNION SELECT preset_id, unnest(sigs) AS sig FROM ar WHERE preset_id NOT IN (SELECT preset_id FROM stored)""")
def x1(v):
    every = v.part.select(F.col("p_brand").alias("preset_id")).distinct()
    return P.all_sigs(every, v.preset_sigs.where("preset_id < 'Brand#2'"), asset_rules(v))


@query("X2_sig_overlap", """
SELECT o_orderkey, len(list_intersect(list(DISTINCT l_linenumber), list(DISTINCT CAST(l_quantity AS INT)))) AS n_common
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def x2(v):
    j = v.lineitem.join(v.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    sets = j.groupBy("o_orderkey").agg(F.collect_set("l_linenumber").alias("a"),
                                       F.collect_set(F.col("l_quantity").cast("int")).alias("b"))
    return sets.select("o_orderkey", P.sig_overlap(F.col("a"), F.col("b")).cast("long").alias("n_common"))


@query("X3_unmatched_sigs", "SELECT preset_id, sig FROM V_preset_sigs WHERE sig NOT IN (SELECT sig FROM V_csigs)")
def x3(v):
    return v.preset_sigs.join(S.fingerprint(v.bindings).select("sig"), "sig", "left_anti").select("preset_id", "sig")
