"""R1-R21 on the given tables."""
from pyspark.sql import functions as F

from assetlake.functions.classify import only_filter
from assetlake.functions.rules import rule
from assetlake.operators import assets as A
from assetlake.operators import facts as FT
from assetlake.operators import outcomes as O
from assetlake.operators import presets as P
from assetlake.operators import resolve as R
from assetlake.operators import summaries as S
from assetlake.registry import sqltext as T
from assetlake.registry.core import query
from assetlake.registry.q_projections import _PROPS_SQL, _props
from assetlake.schemas import RULE
from assetlake.registry.rules_data import (
    ASSET_RULES_SQL, HITS_SQL, PLANS_SQL, RUNS_SQL, asset_rules, brand_plans, plan_quality, runs)

RULE_COLS = ["format", "size", "sharpen_pct", "sharpen_mode", "gray_a", "up"]


def flat_rule(df, name="rule", prefix=""):
    """Spread a rule struct over plain columns."""
    return df.select(*[c for c in df.columns if c != name],
                     *[F.col(f"{name}.{c}").alias(prefix + c) for c in RULE_COLS])


# R2 as SQL: one row per asset with the merged rule (NULL when an owner blocks)
MERGED = f"""merged AS (SELECT container_id, asset_id, count(*) AS k, count(*) FILTER (WHERE off) AS n_off,
  string_agg(CASE WHEN off THEN owner_key::VARCHAR END, ',' ORDER BY owner_key) AS off_keys,
  {T.rank_fmt(f"min({T.fmt_rank('format')}) FILTER (WHERE NOT off)")} AS format, max(size) FILTER (WHERE NOT off) AS size,
  CASE WHEN count(sharpen_pct) FILTER (WHERE NOT off) = count(*) FILTER (WHERE NOT off) THEN min(sharpen_pct) FILTER (WHERE NOT off) END AS sharpen_pct,
  CASE WHEN count(DISTINCT coalesce(sharpen_mode, '')) FILTER (WHERE NOT off) = 1 THEN min(sharpen_mode) FILTER (WHERE NOT off) END AS sharpen_mode,
  CASE WHEN count(DISTINCT coalesce(gray_a, -1)) FILTER (WHERE NOT off) = 1 THEN min(gray_a) FILTER (WHERE NOT off) END AS gray_a,
  CASE WHEN count(*) = 1 THEN max(up) FILTER (WHERE NOT off) END AS up FROM (
    SELECT o.container_id, o.asset_id, o.owner_key, r.* EXCLUDE owner_key, r.format IS NULL OR r.format = 'keep' AS off
    FROM (SELECT DISTINCT container_id, asset_id, owner_key FROM V_bindings) o LEFT JOIN V_owner_rules r USING (owner_key)) GROUP BY ALL)"""

HITS = f"""{HITS_SQL}, best AS (SELECT container_id, asset_id, {T.rank_fmt(f"min({T.fmt_rank('format')})")} AS format,
  CAST(max(size) AS INT) AS size, count(*) AS n_hits FROM hits GROUP BY ALL)"""

ROUTES = """routes AS (SELECT container_id, CASE WHEN score >= 0.19 THEN 'apply' ELSE 'uniform' END AS action FROM (
  SELECT s_suppkey AS container_id, coalesce(n, 0) / (SELECT count(*) FROM V_preset_sigs WHERE preset_id = 'Brand#7') AS score
  FROM supplier LEFT JOIN (SELECT container_id, count(*) AS n FROM V_csigs JOIN V_preset_sigs USING (sig)
    WHERE preset_id = 'Brand#7' GROUP BY 1) ON container_id = s_suppkey))"""


def routes(v, copy_skips=False, force=True):
    c = v.supplier.select(F.col("s_suppkey").alias("container_id"), F.lit("clothes").alias("kind"))
    scored = P.score_against(c, FT.fingerprint(v.facts), v.preset_bindings.where("preset_id = 'Brand#7'"))
    return P.route_containers(scored, "clothes", 0.19, force, "png", copy_skips)


@query("R1_resolve_rules", f"""
WITH {MERGED}, {HITS}, {ROUTES}
SELECT a.container_id, a.asset_id, a.class,
  CASE WHEN u THEN 'png' WHEN b.format IS NOT NULL THEN b.format WHEN m.n_off = 0 THEN m.format ELSE 'auto' END AS format,
  CASE WHEN u THEN 256 WHEN b.format IS NOT NULL THEN b.size WHEN m.n_off = 0 THEN m.size ELSE CASE a.class WHEN 'maintex' THEN 2048 ELSE 1024 END END AS size,
  CASE WHEN u OR b.format IS NOT NULL THEN NULL WHEN m.n_off = 0 THEN m.sharpen_pct END AS sharpen_pct,
  CASE WHEN u OR b.format IS NOT NULL THEN NULL WHEN m.n_off = 0 THEN m.up END AS up,
  CASE WHEN u THEN false WHEN b.format IS NOT NULL THEN b.format = 'keep' ELSE m.n_off IS NULL OR m.n_off > 0 END AS keep,
  CASE WHEN u THEN 'uniform' WHEN b.format IS NOT NULL THEN 'preset' ELSE 'owner' END AS source,
  CASE WHEN u THEN 'container does not match the preset' WHEN b.format IS NOT NULL THEN 'single asset rule'
    WHEN m.k IS NULL THEN 'no owner' WHEN m.n_off > 0 THEN 'left alone by ' || m.off_keys
    WHEN m.k > 1 THEN 'shared by its owners' END AS reason
FROM V_classed a LEFT JOIN merged m USING (container_id, asset_id) LEFT JOIN best b USING (container_id, asset_id)
LEFT JOIN (SELECT container_id, action = 'uniform' AS u FROM routes) USING (container_id)""")
def r1(v):
    """On the co-partitioned store: every layer meets the assets where they lie."""
    hits = FT.preset_asset_rules(v.facts, asset_rules(v), runs(v))
    rt = routes(v).withColumn("uniform", rule("png", 256))
    df = R.resolve_rules(v.facts.assets, v.facts.bindings, plan=plan_quality(v), owner_rules=v.owner_rules, asset_hits=hits, routes=rt)
    return df.select("container_id", "asset_id", "class", "rule.format", "rule.size", "rule.sharpen_pct", "rule.up",
                     "keep", "source", "reason")


@query("R1_resolve_masked", f"""
WITH o AS (SELECT container_id, asset_id, bool_or(group_no NOT IN (0, 1, 2, 5)) AS off, bool_or(contains(lower(property), 'maintex')
  OR contains(lower(property), 'matcap')) AS hit FROM V_gbindings GROUP BY ALL)
SELECT a.container_id, a.asset_id, coalesce(off, false) OR NOT coalesce(hit, false) AS keep,
  CASE WHEN coalesce(off, false) THEN 'mask' ELSE 'only' END AS source FROM V_assets a LEFT JOIN o USING (container_id, asset_id)""")
def r1b(v):
    """On the store too: assets are told apart and grouped where they lie, not in the tasks that scan the lines."""
    df = R.resolve_rules(v.facts.assets, v.grouped(v.facts.bindings), only=["maintex", "matcap"], mask=1 + 2 + 4 + 32)
    return df.select("container_id", "asset_id", "keep", "source")


@query("R2_merge_owner_rules", f"""
WITH {MERGED} SELECT container_id, asset_id, n_off = 0 AS enabled, CASE WHEN n_off = 0 THEN format END AS format,
  CASE WHEN n_off = 0 THEN size END AS size, CASE WHEN n_off = 0 THEN sharpen_pct END AS sharpen_pct,
  CASE WHEN n_off = 0 THEN sharpen_mode END AS sharpen_mode, CASE WHEN n_off = 0 THEN gray_a END AS gray_a,
  CASE WHEN n_off = 0 THEN up END AS up FROM merged""")
def r2(v):
    m = A.merge_owner_rules(v.facts.bindings, v.owner_rules)
    return flat_rule(m.select("container_id", "asset_id", F.col("owner_rule").isNotNull().alias("enabled"), "owner_rule"),
                     "owner_rule")


@query("R2_two_presets", f"""
WITH {MERGED}, none AS (SELECT container_id, asset_id, bool_or(slot = 1) AS off FROM V_bindings GROUP BY ALL)
SELECT container_id, asset_id, CASE WHEN container_id % 2 = 0 THEN n_off = 0 ELSE NOT off END AS enabled,
  CASE WHEN container_id % 2 = 0 THEN CASE WHEN n_off = 0 THEN format END WHEN NOT off THEN 'png' END AS format,
  CASE WHEN container_id % 2 = 0 THEN CASE WHEN n_off = 0 THEN size END WHEN NOT off THEN 256 END AS size
FROM merged JOIN none USING (container_id, asset_id)""")
def r2_two(v):
    """Even containers take the rules of one preset, odd ones those of another, which leaves slot 1 alone."""
    two = R.literal_rows(v.spark, [{"preset_id": "odd", "owner_key": b + s, "rule": {"format": "keep" if s == 1 else "png", "size": 256}}
                                   for b in (0, 1000, 2000) for s in range(1, 8)], f"preset_id:string,owner_key:int,rule:{RULE}")
    both = v.owner_rules.select(F.lit("even").alias("preset_id"), "owner_key", "rule").unionByName(two)
    which = v.supplier.select(F.col("s_suppkey").alias("container_id"), F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd").alias("preset_id"))
    m = A.merge_owner_rules(v.facts.bindings, both, which)
    return m.select("container_id", "asset_id", F.col("owner_rule").isNotNull().alias("enabled"), "owner_rule.format", "owner_rule.size")


@query("R3_merge_preset_hits", f"WITH {HITS} SELECT container_id, asset_id, format, size, n_hits FROM best")
def r3(v):
    m = FT.merge_preset_hits(v.facts, asset_rules(v), runs(v))
    return m.select("container_id", "asset_id", "asset_rule.format", "asset_rule.size", "n_hits")


@query("R3_preset_asset_rules", f"WITH {HITS} SELECT container_id, asset_id, format, size FROM best")
def r3b(v):
    m = FT.preset_asset_rules(v.facts, asset_rules(v), runs(v))
    return m.select("container_id", "asset_id", "asset_rule.format", "asset_rule.size")


@query("R4_route_containers", """
WITH s AS (SELECT c_custkey AS container_id, CASE WHEN c_acctbal < 0 THEN 'chara' ELSE 'clothes' END AS kind,
  coalesce(n, 0) / (SELECT count(DISTINCT o_orderpriority || o_orderstatus) FROM orders) AS score FROM customer LEFT JOIN (
    SELECT o_custkey, count(DISTINCT o_orderpriority || o_orderstatus) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)
SELECT container_id, kind, round(score, 9) AS score, CASE WHEN kind <> 'clothes' OR score < 0.5 THEN 'copy' ELSE 'apply' END AS action,
  0 AS rc, kind <> 'clothes' OR score < 0.5 AS copied FROM s""")
def r4(v):
    c = v.customer.select(F.col("c_custkey").alias("container_id"),
                          F.when(F.col("c_acctbal") < 0, "chara").otherwise("clothes").alias("kind"))
    sig = F.concat("o_orderpriority", "o_orderstatus").alias("sig")
    scored = P.score_against(c, v.orders.select(F.col("o_custkey").alias("container_id"), sig), v.orders.select(sig))
    return P.route_containers(scored, "clothes", 0.5, copy_skips=True).withColumn("score", F.round("score", 9))


@query("R4_route_forced", f"WITH {ROUTES} SELECT container_id, action FROM routes")
def r4b(v):
    return routes(v).select("container_id", "action")


@query("R5_only_filter", f"""
SELECT p_partkey, len(list_filter({_PROPS_SQL}, lambda p: contains(lower(p), 'maintex') OR contains(lower(p), 'red'))) > 0 AS allowed FROM part""")
def r5(v):
    return v.part.select("p_partkey", only_filter(_props(), ["maintex", "red"]).alias("allowed"))


_R6 = f"""d AS (SELECT c.container_id, c.asset_id, c.class, p.flat_alpha, p.circle_only, p.width, p.height, coalesce(k.risky, false) AS risky,
  coalesce(k.n_owners = 1, false) AS exclusive, CASE c.class WHEN 'maintex' THEN 2048 ELSE 1024 END AS rsize
  FROM V_classed c JOIN V_assets p USING (container_id, asset_id) LEFT JOIN V_asset_class k USING (container_id, asset_id))"""


@query("R6_decide_format", f"""
WITH {_R6}, e AS (SELECT *, (flat_alpha OR (class = 'matcap' AND circle_only)) AND NOT risky AS safe,
  class IN ('emission', 'normal') AND (flat_alpha OR circle_only) AS push FROM d)
SELECT container_id, asset_id, safe OR push AS use_jpeg, NOT (push AND NOT safe) AS auto_mode, rsize AS cap, push AND NOT safe AS forced,
  push AND NOT safe AND NOT flat_alpha AS alpha_lost FROM e""")
def r6(v):
    df = R.resolve_rules(v.assets, v.bindings, plan=plan_quality(v))
    df = R.decide_format(df, force_classes=["emission", "normal"], force_gate=2)
    return df.select("container_id", "asset_id", "use_jpeg", "auto_mode", "cap", "forced", "alpha_lost")


@query("R7_protect_exclusive", f"""
WITH {_R6} SELECT container_id, asset_id, exclusive AND 4096 > rsize AS protected, CASE WHEN exclusive THEN greatest(4096, rsize)
  ELSE rsize END AS cap FROM d""")
def r7(v):
    df = R.decide_format(R.resolve_rules(v.assets, v.bindings, plan=plan_quality(v)))
    return R.protect_exclusive(df).select("container_id", "asset_id", "protected", "cap")


@query("R8_choose_candidate", """
SELECT container_id, asset_id, ord, supp, raw_bytes, fmt, out_bytes, packed FROM V_outcomes""")
def r8(v):
    return O.choose_candidate(v.candidates).select("container_id", "asset_id", "ord", "supp", "raw_bytes", "fmt", "out_bytes", "packed")


@query("R9_apply_uniform", f"""
SELECT plan_id, class, CASE WHEN class = 'maintex' THEN 'jpeg' ELSE format END AS format, CASE WHEN class = 'maintex' THEN 777 ELSE size END AS size,
  CASE WHEN class = 'maintex' THEN 2 END AS up, class = 'maintex' AS touched FROM ({PLANS_SQL})""")
def r9(v):
    df = R.apply_uniform(brand_plans(v), "class", cls="maintex", values={"format": "jpeg", "size": 777}, up=2)
    return df.select("plan_id", "class", "rule.format", "rule.size", "rule.up", "touched")


@query("R9_apply_uniform_group", """
SELECT DISTINCT owner_key, CASE WHEN group_no = 2 THEN 'png' ELSE 'keep' END AS format, CASE WHEN group_no = 2 THEN 512 ELSE 0 END AS size FROM V_gbindings""")
def r9b(v):
    rows = v.gbindings.select("owner_key").distinct().withColumn("rule", rule("keep", 0))
    return R.apply_uniform(rows, "group", group=2, values={"format": "png", "size": 512}).select(
        "owner_key", "rule.format", "rule.size")


@query("R10_build_presets", """
SELECT CAST(container_id AS VARCHAR) AS preset_id, CAST(asset_id AS VARCHAR) AS name, array_to_string(list_sort(list(sig)), ';') AS value,
  'asset' AS part FROM V_asset_sigs GROUP BY 1, 2 UNION ALL
SELECT CAST(container_id AS VARCHAR), NULL, sig, 'fingerprint' FROM V_csigs UNION ALL
SELECT DISTINCT CAST(container_id AS VARCHAR), CAST(owner_key AS VARCHAR), format, 'owner' FROM V_bindings JOIN V_owner_rules USING (owner_key)
UNION ALL SELECT DISTINCT CAST(container_id AS VARCHAR), 'clothes', '0.5', 'preset' FROM V_bindings""")
def r10(v):
    wanted = v.bindings.select("container_id", "asset_id").distinct().withColumn("rule", rule("png", 256))
    p = P.build_presets(v.bindings, v.owner_rules, wanted, min_match=50)
    none = F.lit(None).cast("string")

    def part(df, name, value, kind):
        return df.select("preset_id", name.alias("name"), value.alias("value"), F.lit(kind).alias("part"))
    return (part(p["asset_rules"], F.col("asset_id"), F.array_join("sigs", ";"), "asset")
            .unionByName(part(p["sigs"], none, F.col("sig"), "fingerprint"))
            .unionByName(part(p["owner_rules"], F.col("owner_key").cast("string"), F.col("rule.format"), "owner"))
            .unionByName(part(p["presets"], F.col("kind"), F.col("min_match").cast("string"), "preset")))


@query("R11_final_handling", f"""
WITH {MERGED} SELECT a.container_id, a.asset_id, CASE WHEN k IS NULL THEN 'unchanged -- no owner' WHEN n_off > 0 THEN 'unchanged -- left alone by ' || off_keys
  ELSE format || CASE WHEN size > 0 THEN '/' || size ELSE '/unscaled' END || CASE WHEN sharpen_pct = 0 THEN ' sharpen off'
    WHEN sharpen_pct > 0 THEN ' sharpen ' || sharpen_pct || '%' ELSE '' END || CASE WHEN gray_a = 1 THEN ' gray' WHEN gray_a >= 0 THEN ' no gray' ELSE '' END
    || CASE WHEN k > 1 THEN ' (by its shared rule)' ELSE '' END END AS handling
FROM V_assets a LEFT JOIN merged m USING (container_id, asset_id)""")
def r11(v):
    df = R.resolve_rules(v.assets, v.bindings, owner_rules=v.owner_rules)
    return R.final_handling(df).select("container_id", "asset_id", "handling")


@query("R12_is_noop", f"SELECT plan_id, bool_and(format = 'keep') AS noop FROM ({PLANS_SQL}) GROUP BY 1")
def r12(v):
    return R.is_noop(brand_plans(v))


@query("R13_builtin_plans", """
SELECT plan_id, class, count(*) AS n_assets FROM (
  SELECT c.class, p.plan_id, CASE WHEN c.class = 'maintex' THEN p.m ELSE p.r END AS size,
    CASE WHEN c.class = 'maintex' OR p.plan_id <> 'default' THEN 'auto' ELSE 'keep' END AS format, c.dim FROM V_classed c
  CROSS JOIN (VALUES ('default', 1024, 0), ('optimise', 0, 0), ('quality', 2048, 1024), ('performance', 1024, 512),
    ('aggressive', 1024, 512)) p(plan_id, m, r)) WHERE format <> 'keep' AND size > 0 AND dim > size GROUP BY ALL""")
def r13(v):
    df = R.rules_by_class(S.classed(v.assets, v.bindings), R.builtin_plans(v.spark))
    r = F.col("class_rule")
    return df.where((r["format"] != "keep") & (r["size"] > 0) & (F.col("dim") > r["size"])).groupBy("plan_id", "class").agg(
        F.count(F.lit(1)).alias("n_assets"))


@query("R14_merge_settings", """
SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN k % 2 = 0 END, CASE WHEN event_type <> 'view' THEN k < 50 END, true) AS own_protect,
  coalesce(CASE WHEN event_type = 'error' THEN k END, CASE WHEN value > 10 THEN k * 10 END, 4096) AS own_max FROM (
  SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)""")
def r14(v):
    k, e = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    d = v.events.select(
        "event_id", F.when(e == "click", k % 2 == 0).alias("cli_own_protect"), F.when(e != "view", k < 50).alias("file_own_protect"),
        F.lit(True).alias("default_own_protect"), F.when(e == "error", k).alias("cli_own_max"),
        F.when(F.col("value") > 10, k * 10).alias("file_own_max"), F.lit(4096).alias("default_own_max"))
    m = R.merge_settings("cli_", "file_", "default_", fields=["own_protect", "own_max"])
    return d.select("event_id", *[c.alias(n) for n, c in m.items()])


@query("R15_infer_kind", """
SELECT s_suppkey AS preset_id, CASE WHEN max(CASE WHEN s_acctbal < 2000 THEN owner_key ELSE slot_key END) >= 100000 THEN 'chara' ELSE 'clothes' END AS kind
FROM V_gbindings JOIN supplier ON s_suppkey = container_id GROUP BY 1""")
def r15(v):
    j = v.gbindings.join(v.supplier, F.col("s_suppkey") == F.col("container_id"))
    return P.infer_kind(j.select(F.col("s_suppkey").alias("preset_id"), F.when(
        F.col("s_acctbal") < 2000, F.col("owner_key")).otherwise(F.col("slot_key")).alias("owner_key")))


@query("R17_hdr_plan", """
SELECT p_partkey, CASE WHEN used THEN 'HDR' ELSE 'orig' END AS fmt, CASE WHEN used THEN nb ELSE rb END AS out_bytes,
  CASE WHEN used THEN CAST(greatest(1, round_even(w * (cap::DOUBLE / greatest(w, h)), 0)) AS INT) ELSE w END AS out_width,
  CASE WHEN used THEN CAST(greatest(1, round_even(h * (cap::DOUBLE / greatest(w, h)), 0)) AS INT) ELSE h END AS out_height FROM (
  SELECT *, cap > 0 AND greatest(w, h) > cap AND nb < rb AS used FROM (
    SELECT p_partkey, p_size * 100 AS w, p_size * 55 AS h, CASE WHEN p_type = 'PROMO' THEN 0 WHEN p_type = 'LARGE' THEN 1024 ELSE 700 END AS cap,
      CAST(round(p_retailprice * 100) AS BIGINT) AS rb, 100000 - CAST(p_partkey AS BIGINT) % 20000 AS nb FROM part))""")
def r17(v):
    t = F.col("p_type")
    size = F.when(t == "PROMO", 0).otherwise(700)
    d = v.part.select("p_partkey", (F.col("p_size") * 100).alias("width"), (F.col("p_size") * 55).alias("height"),
                      F.when(t != "LARGE", rule("auto", size)).alias("rule"),
                      F.round(F.col("p_retailprice") * 100).cast("long").alias("raw_bytes"),
                      (100000 - F.col("p_partkey") % 20000).alias("new_bytes"))
    return R.hdr_plan(d).select("p_partkey", "fmt", "out_bytes", "out_width", "out_height")


@query("R18_expand_all_owners", "SELECT container_id, owner_key, 'auto' AS format, 1024 AS size FROM V_parts WHERE n_assets > 0")
def r18(v):
    full = S.complete_owners(S.part_summary(v.bindings, v.assets), v.assets)
    return R.expand_all_owners(full).select("container_id", "owner_key", "rule.format", "rule.size")


@query("R19_lint_plan", f"""
SELECT plan_id, NOT bool_or(format <> 'keep' AND size > 0) AS sharpen_inert FROM ({PLANS_SQL}) GROUP BY 1""")
def r19(v):
    return R.lint_plan(brand_plans(v), F.lit(100))


@query("R20_resolve_by_mode", f"""
WITH {_R6}, h AS (SELECT container_id, asset_id, bool_or(contains(lower(property), 'maintex')) AS hit FROM V_bindings GROUP BY ALL)
SELECT container_id, asset_id, NOT coalesce(hit, false) AS keep, safe AS use_jpeg, CASE WHEN safe THEN 2048 ELSE 512 END AS cap FROM (
  SELECT d.*, h.hit, (flat_alpha OR (class = 'matcap' AND circle_only)) AND NOT risky AS safe FROM d LEFT JOIN h USING (container_id, asset_id))""")
def r20(v):
    p = A.asset_profile(v.bindings, only=["maintex"])
    df = v.assets.join(p, ["container_id", "asset_id"], "left")
    df = df.withColumn("risky", F.coalesce("risky", F.lit(False))).withColumn("class", F.coalesce("class", F.lit("other")))
    return R.resolve_by_mode(df, "maintex", 2048, 512).select("container_id", "asset_id", "keep", "use_jpeg", "cap")


@query("R21_apply_preset_owners", """
SELECT p.container_id, p.owner_key, r.format IS NOT NULL AND r.format <> 'keep' AS enabled, coalesce(r.format, 'keep') AS format,
  coalesce(r.size, 0) AS size FROM V_parts p LEFT JOIN V_owner_rules r USING (owner_key) WHERE n_assets > 0""")
def r21(v):
    full = S.complete_owners(S.part_summary(v.bindings, v.assets), v.assets)
    return P.apply_preset_owners(full, v.owner_rules)


_R21 = f"""ar AS ({ASSET_RULES_SQL}), runs AS ({RUNS_SQL}), rs AS (SELECT preset_id, rule_no, unnest(sigs) AS sig FROM ar),
h AS (SELECT container_id, asset_id, preset_id, rule_no FROM V_asset_sigs JOIN runs USING (container_id) JOIN rs USING (sig, preset_id) UNION
  SELECT container_id, a.asset_id, preset_id, rule_no FROM V_assets a JOIN runs USING (container_id) JOIN ar USING (preset_id)
  WHERE CAST(a.asset_id AS VARCHAR) = ar.asset_id)"""


@query("R21_apply_preset_assets", f"""WITH {_R21} SELECT container_id, h.asset_id, preset_id, max(rule_no) AS rule_no FROM h GROUP BY ALL""")
def r21b(v):
    out = P.apply_preset_assets(v.assets, A.asset_signatures(v.bindings), asset_rules(v), runs(v))
    return out.select("container_id", "asset_id", "preset_id", "rule_no")


@query("R21_preset_counts", f"""
WITH {_R21} SELECT container_id, preset_id, coalesce(n_hits, 0) AS n_hits, n - coalesce(found, 0) AS n_missed
FROM runs LEFT JOIN (SELECT container_id, preset_id, count(*) AS n_hits, count(DISTINCT rule_no) AS found FROM h GROUP BY ALL)
USING (container_id, preset_id) JOIN (SELECT preset_id, count(DISTINCT rule_no) AS n FROM ar GROUP BY 1) USING (preset_id)""")
def r21c(v):
    return P.preset_counts(asset_rules(v), v.facts.bindings, v.facts.assets, runs(v))


@query("R21_preset_counts_no_hit", f"""
WITH {_R21} SELECT s_suppkey AS container_id, 'Brand#' || (s_nationkey + 1) AS preset_id, CAST(0 AS BIGINT) AS n_hits, n AS n_missed
FROM supplier JOIN (SELECT preset_id, count(DISTINCT rule_no) AS n FROM ar GROUP BY 1) q ON q.preset_id = 'Brand#' || (s_nationkey + 1)""")
def r21d(v):
    """Containers whose assets and signatures no rule names."""
    far = v.assets.withColumn("asset_id", -F.col("asset_id") - 1)
    return P.preset_counts(asset_rules(v), A.asset_signatures(v.bindings).withColumn("sig", F.lit("?")), far, runs(v))


@query("R16_verify_tables", """
WITH a AS (SELECT l_orderkey AS container_id, l_linenumber AS asset_id, l_partkey AS ord, CAST(CASE WHEN l_quantity >= 49 THEN 0 ELSE l_quantity END AS INT) AS width,
  CASE WHEN l_returnflag = 'A' THEN 'PNG' WHEN l_returnflag = 'N' THEN 'JPEG' WHEN l_quantity > 25 THEN 'HDR' ELSE 'EXR' END AS fmt FROM lineitem),
s AS (SELECT container_id, count(*) AS n, count(*) FILTER (WHERE fmt = 'HDR') AS h, count(*) FILTER (WHERE fmt = 'EXR') AS u,
  min(struct_pack(o := ord, a := asset_id)) FILTER (WHERE fmt <> 'EXR' AND width <= 0) AS bad FROM a GROUP BY 1)
SELECT container_id, rc <> 6 AND (bad IS NULL) AS ok, CASE WHEN rc = 3 THEN 'no assets' WHEN rc = 6 THEN 'structure broken'
  WHEN bad IS NOT NULL THEN 'asset ' || bad.a || ' does not decode' ELSE coalesce(n, 0) || ' assets readable' END AS message,
  coalesce(n, 0) AS n_assets, coalesce(h, 0) AS n_hdr, coalesce(u, 0) AS n_other
FROM V_containers LEFT JOIN s USING (container_id)""")
def r16_tables(v):
    """Result tables as they are after a run: one row for each asset with format, width and place."""
    q, f = F.col("l_quantity"), F.col("l_returnflag")
    a = v.lineitem.select(F.col("l_orderkey").alias("container_id"), F.col("l_linenumber").alias("asset_id"), F.col("l_partkey").alias("ord"),
                          F.when(q >= 49, 0).otherwise(q).cast("int").alias("width"),
                          F.when(f == "A", "PNG").when(f == "N", "JPEG").when(q > 25, "HDR").otherwise("EXR").alias("fmt"))
    return O.verify(v.containers.select("container_id", "rc"), a)
