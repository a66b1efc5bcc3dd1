"""A1-A17 on the given tables."""
from pyspark.sql import functions as F

from assetlake.operators import assets as A
from assetlake.operators import outcomes as O
from assetlake.operators import summaries as S
from assetlake.registry import sqltext as T
from assetlake.registry.core import query


@query("A1_class_stats", "SELECT * FROM V_class_stats")
def a1(v):
    return S.class_stats(S.classed(v.assets, v.bindings))


@query("A2_corpus_totals", """
SELECT coalesce(class, 'total') AS class, CAST(sum(n_assets) AS BIGINT) AS n_assets, CAST(sum(n_bytes) AS BIGINT) AS n_bytes,
  max(max_dim) AS max_dim FROM V_class_stats GROUP BY ROLLUP (class)""")
def a2(v):
    return S.corpus_totals(S.class_stats(S.classed(v.assets, v.bindings)))


@query("A3_describe", f"""
SELECT s_suppkey AS container_id, CASE WHEN n > 0 THEN s_name || chr(10) || printf('  %d assets / %s', n, {T.human('b')})
  || chr(10) || body ELSE s_name || chr(10) || '  no embedded assets' END AS description FROM supplier LEFT JOIN (
  SELECT container_id, CAST(sum(n_assets) AS BIGINT) AS n, CAST(sum(n_bytes) AS BIGINT) AS b,
    string_agg(printf('    %-10s %4d  %10s  max %dpx', class, n_assets, {T.human('n_bytes')}, max_dim), chr(10)
    ORDER BY {T.class_ord('class')}) AS body FROM V_class_stats GROUP BY 1) ON container_id = s_suppkey""")
def a3(v):
    c = v.supplier.select(F.col("s_suppkey").alias("container_id"), F.col("s_name").alias("title"))
    return S.describe(c, S.class_stats(S.classed(v.assets, v.bindings)))


@query("A4_asset_props", "SELECT DISTINCT container_id, asset_id, property FROM V_bindings")
def a4(v):
    return A.asset_props(v.bindings)


@query("A4_asset_props_missing", "SELECT DISTINCT container_id, asset_id, property FROM V_bindings WHERE slot <> 2")
def a4_missing(v):
    """Bindings of slot 2 have no property."""
    return A.asset_props(v.bindings.withColumn("property", F.when(F.col("slot") != 2, F.col("property"))))


@query("A5_asset_owners", """
SELECT container_id, asset_id, array_to_string(list_sort(list_distinct(list(owner_key))), ',') AS owners,
  CAST(count(DISTINCT owner_key) AS INT) AS n_owners, count(DISTINCT owner_key) > 1 AS shared FROM V_bindings GROUP BY ALL""")
def a5(v):
    return A.asset_owners(v.bindings).withColumn(
        "owners", F.array_join(F.transform("owners", lambda k: k.cast("string")), ","))


@query("A6_asset_signatures", "SELECT * FROM V_asset_sigs")
def a6(v):
    return A.asset_signatures(v.bindings)


@query("A7_fingerprint", "SELECT container_id, sig FROM V_csigs")
def a7(v):
    return S.fingerprint(v.bindings)


@query("A7_fingerprint_chara", f"""
WITH b AS (SELECT V_gbindings.* FROM V_gbindings JOIN supplier ON s_suppkey = container_id WHERE NOT (obj_type >= 3 AND s_acctbal < 4000)),
body AS (SELECT DISTINCT container_id, {T.sig('slot_key', 'material', 'property')} AS sig FROM b WHERE obj_type >= 3)
SELECT * FROM body UNION
SELECT container_id, ({T.owner_name('owner_key')}) || '|' || {T.norm_material('material')} || '|' || property AS sig FROM b
WHERE container_id NOT IN (SELECT container_id FROM body)""")
def a7b(v):
    # containers of low-balance suppliers lose their body bindings, so that the fallback has work to do
    b = v.bindings.join(v.supplier, F.col("s_suppkey") == F.col("container_id"))
    return S.fingerprint(b.where("not (obj_type >= 3 and s_acctbal < 4000)"), grouped=True)


@query("A8_part_summary", """
SELECT p.*, m.materials FROM V_parts p JOIN (SELECT container_id, owner_key,
  array_to_string(list_sort(list_distinct(list(material))), ',') AS materials FROM V_bindings GROUP BY ALL) m
USING (container_id, owner_key)""")
def a8(v):
    return S.part_summary(v.bindings, v.assets, materials=True)


@query("A8_part_summary_gaps", """
WITH b AS (SELECT container_id, CASE WHEN slot = 5 THEN -asset_id ELSE asset_id END AS asset_id, owner_key,
  CASE WHEN slot = 3 THEN '' ELSE material END AS material FROM V_bindings),
o AS (SELECT DISTINCT container_id, asset_id, owner_key FROM b),
k AS (SELECT container_id, asset_id, count(*) AS k FROM o GROUP BY ALL),
m AS (SELECT container_id, owner_key, coalesce(string_agg(material, ',' ORDER BY material), '') AS materials
  FROM (SELECT DISTINCT container_id, owner_key, CASE WHEN material <> '' THEN material END AS material FROM b) GROUP BY ALL)
SELECT container_id, owner_key, count(n_bytes) AS n_assets, CAST(coalesce(sum(n_bytes), 0) AS BIGINT) AS n_bytes,
  count(n_bytes) FILTER (WHERE k = 1) AS own_count, CAST(coalesce(sum(n_bytes) FILTER (WHERE k = 1), 0) AS BIGINT) AS own_bytes,
  any_value(materials) AS materials
FROM o JOIN k USING (container_id, asset_id) JOIN m USING (container_id, owner_key) LEFT JOIN V_assets USING (container_id, asset_id)
GROUP BY container_id, owner_key""")
def a8_gaps(v):
    """Slot 5 names assets that are not there, slot 3 has empty material names."""
    b = v.bindings.withColumn("asset_id", F.when(F.col("slot") == 5, -F.col("asset_id")).otherwise(F.col("asset_id")))
    b = b.withColumn("material", F.when(F.col("slot") == 3, F.lit("")).otherwise(F.col("material")))
    return S.part_summary(b, v.assets, materials=True)


@query("A9_group_summary", """
SELECT container_id, owner_key // 100000 - 1 AS group_no, 'part' AS level, owner_key, CAST(1 AS BIGINT) AS n_parts, n_assets, n_bytes
FROM V_gparts UNION ALL
SELECT container_id, owner_key // 100000 - 1, 'group', NULL, count(*), CAST(sum(n_assets) AS BIGINT), CAST(sum(n_bytes) AS BIGINT)
FROM V_gparts GROUP BY 1, 2""")
def a9(v):
    return S.group_summary(S.part_summary(v.gbindings, v.assets))


@query("A10_owner_count", "SELECT container_id, count(DISTINCT owner_key) AS n_owner_keys FROM V_gbindings GROUP BY 1")
def a10(v):
    return S.owner_count(v.gbindings, ["container_id"])


@query("A10_owner_count_approx")
def a10b(v):
    return S.owner_count(v.gbindings, ["container_id"], approx=True)


@query("A10_owner_count_bound", "SELECT DISTINCT container_id, true AS near FROM V_bindings")
def a10c(v):
    """The sketch stays within 15 % of the exact count."""
    exact, about = S.owner_count(v.gbindings, ["container_id"]), S.owner_count(v.gbindings, ["container_id"], approx=True)
    n = [c for c in exact.columns if c != "container_id"][0]
    j = exact.join(about.select("container_id", F.col(n).alias("_about")), "container_id")
    return j.select("container_id", (F.abs(F.col("_about") - F.col(n)) <= 0.15 * F.col(n)).alias("near"))


_ROLLUP = """SELECT container_id, count(*) AS n_assets, count(*) FILTER (WHERE fmt = 'JPEG') AS n_jpeg,
  count(*) FILTER (WHERE fmt = 'PNG') AS n_png, CAST(0 AS BIGINT) AS n_hdr, CAST(0 AS BIGINT) AS n_keep,
  count(*) FILTER (WHERE fmt = 'orig') AS n_same, count(*) FILTER (WHERE fmt IN ('PNG*', 'JPEG*')) AS n_keep_opt,
  CAST(coalesce(sum(raw_bytes - out_bytes) FILTER (WHERE fmt IN ('PNG*', 'JPEG*')), 0) AS BIGINT) AS keep_opt_saved,
  count(*) FILTER (WHERE packed) AS n_packed,
  CAST(coalesce(sum(CASE WHEN picked = 'png' THEN png_bytes ELSE raw_bytes END - out_bytes) FILTER (WHERE packed), 0) AS BIGINT) AS packed_saved,
  count(*) FILTER (WHERE upscaled) AS n_upscaled, CAST(sum(raw_bytes) AS BIGINT) AS payload_before,
  CAST(sum(out_bytes) AS BIGINT) AS payload_after FROM V_outcomes GROUP BY 1"""


@query("A11_container_rollup", f"SELECT *, round(100.0::DOUBLE * payload_after / greatest(payload_before, 1), 6) AS payload_pct FROM ({_ROLLUP})")
def a11(v):
    out = S.container_rollup(O.choose_candidate(v.candidates))
    return out.withColumn("payload_pct", F.round("payload_pct", 6)).drop(
        "n_protected", "n_blocked_data", "n_blocked_cap", "up_pixels_before", "up_pixels_after")


@query("A11_outcome_lists", """
SELECT container_id, asset_id, ord, 'upscaled' AS list_name FROM V_outcomes WHERE upscaled UNION ALL
SELECT container_id, asset_id, ord, 'unchanged' FROM V_outcomes WHERE fmt = 'orig' UNION ALL
SELECT container_id, asset_id, ord, 'packed' FROM V_outcomes WHERE packed""")
def a11b(v):
    return S.outcome_lists(O.choose_candidate(v.candidates), {
        "upscaled": F.col("upscaled"), "unchanged": F.col("fmt") == "orig", "packed": F.col("packed")})


_CO = """SELECT o_orderkey AS container_id, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL
  WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 3 ELSE CAST(substr(o_orderpriority, 1, 1) AS INT) + 2 END AS rc,
  o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AS copied, o_totalprice > 20000 AS verified,
  CASE WHEN o_custkey < 50 THEN 'given' ELSE '' END AS reason, CAST(round(o_totalprice * 100) AS BIGINT) AS bytes_before,
  CAST(round(o_totalprice * 100) AS BIGINT) // 3 AS bytes_after FROM orders"""


def _co(v):
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    rc = (F.when((pr == "5-LOW") & (st == "P"), None).when(st == "F", 0).when(st == "O", 3)
          .otherwise(F.substring(pr, 1, 1).cast("int") + 2))
    total = F.round(F.col("o_totalprice") * 100).cast("long")
    return v.orders.select(
        F.col("o_orderkey").alias("container_id"), rc.alias("rc"), ((st == "F") & (pr == "2-HIGH")).alias("copied"),
        (F.col("o_totalprice") > 20000).alias("verified"), F.when(F.col("o_custkey") < 50, "given").otherwise("").alias("reason"),
        total.alias("bytes_before"), F.floor(total / 3).alias("bytes_after"))


@query("A12_batch_summary", f"""
WITH co AS ({_CO}) SELECT *, round(100.0::DOUBLE * bytes_after / greatest(bytes_before, 1), 6) AS pct FROM (SELECT
  count(*) FILTER (WHERE rc = 0 AND NOT copied AND verified) AS n_ok, count(*) FILTER (WHERE rc IN (3, 6)) AS n_skipped,
  count(*) FILTER (WHERE rc IS NULL OR (rc <> 0 AND rc NOT IN (3, 6)) OR (rc = 0 AND NOT copied AND NOT verified)) AS n_failed,
  count(*) FILTER (WHERE rc = 0 AND copied) AS n_copied,
  CAST(sum(bytes_before) FILTER (WHERE rc = 0 AND NOT copied) AS BIGINT) AS bytes_before,
  CAST(sum(bytes_after) FILTER (WHERE rc = 0 AND NOT copied) AS BIGINT) AS bytes_after FROM co)""")
def a12(v):
    return S.batch_summary(_co(v)).withColumn("pct", F.round("pct", 6))


@query("A12_batch_lists", f"""
WITH co AS ({_CO}) SELECT container_id, CASE WHEN rc IN (3, 6) THEN 'skipped' ELSE 'failed' END AS list,
  CASE WHEN rc = 0 THEN 'output failed verification' WHEN reason <> '' THEN reason ELSE CASE rc WHEN 3 THEN 'no assets inside'
  WHEN 4 THEN 'broken asset dictionary' WHEN 5 THEN 'cancelled' WHEN 6 THEN 'does not match the preset, skipped'
  ELSE 'unknown code ' || rc END END AS reason
FROM co WHERE rc IS NULL OR rc <> 0 OR (NOT copied AND NOT verified)""")
def a12b(v):
    return S.batch_lists(_co(v))


@query("A13_payload_totals", """
SELECT root_id, CAST(sum(n_bytes_before) AS BIGINT) AS payload_before, CAST(sum(n_bytes_before // 4) AS BIGINT) AS payload_after,
  round(100.0::DOUBLE * sum(n_bytes_before // 4) / greatest(sum(n_bytes_before), 1), 6) AS pct FROM V_containers GROUP BY 1""")
def a13(v):
    from assetlake.functions.sizes import pct
    out = v.containers.groupBy("root_id").agg(
        F.sum("n_bytes_before").alias("payload_before"), F.sum(F.floor(F.col("n_bytes_before") / 4)).alias("payload_after"))
    return out.withColumn("pct", F.round(pct(F.col("payload_after"), F.col("payload_before")), 6))


@query("A14_group_probe", """
SELECT greatest(max(owner_key // 100000 - 1), 7) AS max_group, count(*) FILTER (WHERE owner_key // 100000 - 1 > 30) AS owners_beyond
FROM V_gparts WHERE container_id IN (SELECT DISTINCT container_id FROM V_gparts ORDER BY 1 LIMIT 6)""")
def a14(v):
    return S.group_probe(S.part_summary(v.gbindings, v.assets))


@query("A15_parts_in_use", "SELECT container_id, count(*) AS parts_in_use FROM V_parts WHERE n_assets > 0 GROUP BY 1")
def a15(v):
    return S.parts_in_use(S.complete_owners(S.part_summary(v.bindings, v.assets), v.assets))


@query("A16_byte_share", """
SELECT class, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, round(100.0::DOUBLE * sum(n_bytes) / (SELECT sum(n_bytes) FROM V_classed), 6)
  AS share_pct FROM V_classed GROUP BY 1""")
def a16(v):
    out = S.byte_share(S.classed(v.assets, v.bindings), "class")
    return out.withColumn("share_pct", F.round("share_pct", 6))


@query("A16_byte_share_per_container", """
SELECT container_id, owner_key, n_bytes, round(100.0::DOUBLE * n_bytes / sum(n_bytes) OVER (PARTITION BY container_id), 6) AS share_pct
FROM V_parts""")
def a16b(v):
    out = S.byte_share(S.part_summary(v.bindings, v.assets), "owner_key", ["container_id"])
    return out.withColumn("share_pct", F.round("share_pct", 6))


@query("A17_blockers", """
SELECT b.container_id, b.asset_id, count(DISTINCT b.owner_key) FILTER (WHERE r.format IS NULL OR r.format = 'keep') = 0 AS all_enabled,
  coalesce(array_to_string(list_sort(list_distinct(list(b.owner_key) FILTER (WHERE r.format IS NULL OR r.format = 'keep'))), ','), '')
  AS blockers FROM V_bindings b LEFT JOIN V_owner_rules r USING (owner_key) GROUP BY ALL""")
def a17(v):
    m = A.merge_owner_rules(v.bindings, v.owner_rules)
    return m.select("container_id", "asset_id", (F.size("blockers") == 0).alias("all_enabled"),
                    F.array_join(F.transform("blockers", lambda k: k.cast("string")), ",").alias("blockers"))
