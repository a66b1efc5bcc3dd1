"""W1-W9, X4, X5 on the given tables. Orders show as positions where the oracle can check them."""
from pyspark.sql import functions as F

from assetlake.functions.text import human_bytes
from assetlake.operators import ordering as W
from assetlake.operators import summaries as S
from assetlake.operators.assets import first_wins
from assetlake.registry import sqltext as T
from assetlake.registry.core import query, with_place
from assetlake.session import cut_lineage


@query("W1_first_wins", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n
FROM events) WHERE n = 1""")
def w1(v):
    e = v.events.select("user_id", "event_type", "ts", "event_id", "value")
    return first_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("W2_order_by_class", f"""
SELECT container_id, class, n_assets, {T.class_ord('class')} AS pos FROM V_class_stats ORDER BY container_id, pos""")
def w2(v):
    from assetlake.functions.classify import class_ord
    stats = S.class_stats(S.classed(v.assets, v.bindings))
    out = stats.select("container_id", "class", "n_assets", class_ord(F.col("class")).alias("pos"))
    return W.order_by_class(out, "container_id")


@query("W3_order_parts", """
SELECT d.container_id, d.owner_key, coalesce(p.n_assets, 0) AS n_assets,
  rank() OVER (ORDER BY container_id, coalesce(p.n_assets, 0) = 0, owner_key) AS place FROM (
  SELECT container_id, owner_key FROM V_parts UNION
  SELECT container_id, unnest(range(9))::INT FROM (SELECT DISTINCT container_id FROM V_assets)) d
LEFT JOIN V_parts p USING (container_id, owner_key)""")
def w3(v):
    full = S.complete_owners(S.part_summary(v.bindings, v.assets), v.assets)
    return with_place(W.order_parts(full).select("container_id", "owner_key", "n_assets"), "container_id", "owner_key")


@query("W4_order_assets", """
SELECT container_id, owner_key, asset_id, n_bytes, row_number() OVER (PARTITION BY container_id, owner_key ORDER BY n_bytes DESC, asset_id) AS pos
FROM (SELECT DISTINCT container_id, owner_key, asset_id FROM V_bindings) JOIN V_assets USING (container_id, asset_id)""")
def w4(v):
    # the ranks read their rows four times, the sort once more: the joins below run once
    rows = cut_lineage(v.bindings.select("container_id", "owner_key", "asset_id").distinct().join(
        v.assets.select("container_id", "asset_id", "n_bytes"), ["container_id", "asset_id"]))
    ranked = W.rank_within(rows, ["container_id", "owner_key"], [-F.col("n_bytes"), F.col("asset_id")], "pos")
    return W.order_assets(ranked).select("container_id", "owner_key", "asset_id", "n_bytes", "pos")


@query("W5_sort_table", f"""
SELECT container_id, owner_key, shown, rank() OVER (ORDER BY CAST(floor(CAST(split_part(shown, ' ', 1) AS DOUBLE) *
    CASE split_part(shown, ' ', 2) WHEN 'KB' THEN 1024.0 WHEN 'MB' THEN 1048576.0 WHEN 'GB' THEN 1073741824.0 ELSE 1.0 END) AS BIGINT) DESC,
  owner_key, container_id) AS place FROM (SELECT container_id, owner_key, {T.human('n_bytes')} AS shown FROM V_parts)""")
def w5(v):
    parts = S.part_summary(v.bindings, v.assets).select(
        "container_id", "owner_key", human_bytes(F.col("n_bytes")).alias("shown"))
    return with_place(W.sort_table(parts, "shown", "size", desc=True), "container_id", "owner_key")


@query("W6_cap_details", """
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n
FROM events) WHERE n <= 12""")
def w6(v):
    return W.cap_details(v.events, 12, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("W7_dedupe_names", """
WITH f AS (SELECT c_custkey, c_nationkey AS rel_dir, c_mktsegment AS stem, lpad(c_custkey::VARCHAR, 12, '0') AS path FROM customer),
e AS (SELECT n_nationkey AS rel_dir, CASE WHEN n_regionkey = 1 THEN 'BUILDING' WHEN n_regionkey = 2 THEN 'MACHINERY_4' ELSE 'zzz' END AS stem FROM nation),
r AS (SELECT f.*, row_number() OVER (PARTITION BY rel_dir, stem ORDER BY path) + CASE WHEN EXISTS (
    SELECT 1 FROM e WHERE e.rel_dir = f.rel_dir AND e.stem = f.stem) THEN 1 ELSE 0 END AS pos,
  CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.rel_dir = f.rel_dir AND e.stem = f.stem || '_4') THEN 4 ELSE 1 END AS top FROM f)
SELECT c_custkey, rel_dir, CASE WHEN pos = 1 THEN stem ELSE stem || '_' || (top + pos - 1) END AS out_stem FROM r""")
def w7(v):
    f = v.customer.select("c_custkey", F.col("c_nationkey").alias("rel_dir"), F.col("c_mktsegment").alias("stem"),
                          F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("path"))
    r = F.col("n_regionkey")
    e = v.nation.select(F.col("n_nationkey").alias("rel_dir"), F.when(r == 1, "BUILDING").when(r == 2, "MACHINERY_4")
                        .otherwise("zzz").alias("stem"))
    return W.dedupe_names(f, e).select("c_custkey", "rel_dir", "out_stem")


@query("W8_order_paths", "SELECT page_id, path, rank() OVER (ORDER BY lower(path), path) AS place FROM V_files")
def w8(v):
    return with_place(W.order_paths(v.files.select("page_id", "path")), "path")


@query("W9_hist_quantile", """
WITH b AS (SELECT vec_id, least(greatest(CAST(floor((CAST(e AS DOUBLE) + 0.3) * 100) AS INT), 0), 255) AS b FROM (
  SELECT vec_id, unnest(embedding) AS e FROM embeddings)),
h AS (SELECT vec_id, b, count(*) AS c FROM b GROUP BY ALL),
r AS (SELECT vec_id, b, sum(CASE WHEN b >= 1 THEN c ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY b) AS run,
  CAST(floor(sum(c) OVER (PARTITION BY vec_id) * 0.95) AS BIGINT) AS want FROM h)
SELECT vec_id, CAST(greatest(coalesce(min(b) FILTER (WHERE b >= 1 AND run >= want), 256), 4) AS INT) AS quantile FROM r GROUP BY 1""")
def w9(v):
    e = v.embeddings.select("vec_id", F.explode("embedding").alias("e"))
    return W.hist_quantile(e, ["vec_id"], F.floor((F.col("e").cast("double") + 0.3) * 100))


@query("X4_union_inputs", """
SELECT page_id AS id, url AS path, 0 AS input_no FROM pages UNION ALL SELECT doc_id, source, 1 FROM documents
UNION ALL SELECT conv_id, role, 2 FROM conversations""")
def x4(v):
    return W.union_inputs(v.pages.select(F.col("page_id").alias("id"), F.col("url").alias("path")),
                          v.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("path")),
                          v.conversations.select(F.col("conv_id").alias("id"), F.col("role").alias("path")))


_WORDS = "unnest(string_split_regex({}, '[^a-zà-ÿ]+'))"


def _words(df, col):
    return df.select(F.explode(F.split(F.lower(col), "[^a-zà-ÿ]+")).alias("text")).where("text <> ''")


@query("X5_coverage_audit", f"""
WITH w AS (SELECT w AS text, count(*) AS n FROM (SELECT {_WORDS.format('lower(text)')} AS w FROM documents) WHERE w <> '' GROUP BY 1),
t AS (SELECT DISTINCT {_WORDS.format('lower(text)')} AS text FROM benchmark)
SELECT CAST(sum(n) AS BIGINT) AS n_total, count(*) AS n_distinct, count(*) FILTER (WHERE text NOT IN (SELECT text FROM t)) AS n_missing FROM w""")
def x5(v):
    return W.coverage_audit(_words(v.documents, "text"), _words(v.benchmark, "text").withColumnRenamed("text", "source"))


@query("X5_missing_terms", f"""
SELECT DISTINCT w AS text FROM (SELECT {_WORDS.format('lower(text)')} AS w FROM documents) WHERE w <> ''
AND w NOT IN (SELECT {_WORDS.format('lower(text)')} FROM benchmark)""")
def x5b(v):
    return W.missing_terms(_words(v.documents, "text"), _words(v.benchmark, "text").withColumnRenamed("text", "source"))
