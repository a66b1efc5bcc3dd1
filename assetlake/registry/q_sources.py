"""S1-S8, K1-K4, R16, I1, I2 on the given tables."""
from pyspark.sql import functions as F

from assetlake.functions.rules import rule
from assetlake.operators import outcomes as O
from assetlake.operators import summaries as S
from assetlake.registry import container_data as D
from assetlake.registry import sqltext as T
from assetlake.registry.core import query, with_place
from assetlake.registry.rules_data import PLANS_SQL, asset_rules, brand_plans
from assetlake.registry.views import _PROP_SQL
from assetlake.session import cut_lineage
from assetlake.sources import containers as C
from assetlake.sources import corpus, rules_json, sinks
from assetlake.sources import sniff as N
from assetlake.sources import walk as W
from assetlake.streaming import incremental as I

# ---- listing ------------------------------------------------------------------------------------

_LISTING = """listing AS (SELECT page_id, host, n_chars, CASE WHEN n_chars % 3 = 0 THEN lang || '[Zip]' WHEN n_chars % 3 = 1 THEN lang || '/deep'
  ELSE '' END AS sub FROM (SELECT page_id, length(html) AS n_chars, split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS lang FROM pages)),
dirs AS (SELECT page_id, host || CASE WHEN sub = '' THEN '' ELSE '/' || sub END AS rel_dir, host FROM listing)"""


def _listing(v):
    host, lang, n = F.split_part("url", F.lit("/"), F.lit(3)), F.split_part("url", F.lit("/"), F.lit(4)), F.length("html")
    sub = F.when(n % 3 == 0, F.concat(lang, F.lit("[Zip]"))).when(n % 3 == 1, F.concat(lang, F.lit("/deep")))
    folder = F.concat_ws("/", F.lit("file:/corpus"), host, sub)
    return v.pages.select("page_id", F.concat(folder, F.lit("/"), "page_id", F.lit(".png")).alias("path"), host.alias("host"))


@query("S1_list_corpus", f"""
WITH {_LISTING} SELECT page_id, rel_dir FROM dirs WHERE NOT contains(rel_dir, '[Zip]') AND length(host) % 4 <> 0
AND host NOT IN (SELECT max(host) FROM dirs WHERE length(host) % 4 <> 0)""")
def s1(v):
    files = _listing(v)
    # every fourth host length carries a marker file; the last other host is the output directory
    marks = files.where(F.length("host") % 4 == 0).select(F.concat(F.lit("file:/corpus/"), "host", F.lit("/.asset-output")).alias("path"))
    out = files.where(F.length("host") % 4 != 0).agg(F.max("host").alias("host"))
    kept = corpus.prune_listing(files, marks.distinct(), "/corpus")
    return kept.join(out, "host", "left_anti").select("page_id", "rel_dir")


@query("S1_walk_tree", f"""
WITH {_LISTING}, named AS (SELECT page_id, rel_dir, host, split_part(rel_dir, '/', 2) AS lang FROM dirs)
SELECT page_id, rel_dir FROM named WHERE NOT contains(rel_dir, '[Zip]') AND length(host) % 4 <> 0
AND host NOT IN (SELECT max(host) FROM dirs) AND NOT (lang <> '' AND (length(host) + length(lang)) % 4 = 1)""")
def s1_walk(v):
    files = _listing(v).select("path", "host", F.split("path", "/").alias("p"))
    steps = F.sequence(F.lit(2), F.size("p") - 1)
    entries = files.select("p", F.explode(steps).alias("n")).select(
        F.array_join(F.slice("p", F.lit(1), F.col("n")), "/").alias("dir"), F.get("p", F.col("n")).alias("name"), (F.col("n") < F.size("p") - 1).alias("is_dir"))
    host, lang = F.get(F.split("dir", "/"), F.lit(2)), F.get(F.split("dir", "/"), F.lit(3))
    # a marker at the root hides nothing; every fourth host, and some directories one step below a host, have one
    marked = (host.isNull() | (lang.isNull() & (F.length(host) % 4 == 0))
              | (lang.isNotNull() & (F.size(F.split("dir", "/")) == 4) & ~lang.contains("[Zip]") & ((F.length(host) + F.length(lang)) % 4 == 1)))
    marks = entries.where(marked).select("dir", F.lit(corpus.DEFAULT_MARKER).alias("name"), F.lit(False).alias("is_dir"))
    tree = entries.unionByName(marks).distinct().withColumns({"length": F.lit(0).cast("long"), "modificationTime": F.lit(None).cast("timestamp")})
    out = files.agg(F.max("host")).first()[0]
    roots = files.limit(1).select(F.lit("file:/corpus").alias("dir"))
    found = W.walk(roots, W.table_lister(tree), exclude=f"file:/corpus/{(out or '').upper()}")
    return found.select(F.regexp_extract("path", r"([0-9]+)\.png\z", 1).cast("long").alias("page_id"), "rel_dir")


@query("S2_head", """
SELECT doc_id, CAST(least(1048576, strlen(text)) AS INT) AS n_head, md5(text) AS digest FROM documents""")
def s2(v):
    h = corpus.head(v.documents.select("doc_id", F.encode("text", "utf-8").alias("content")))
    return h.select("doc_id", F.octet_length("head").alias("n_head"), F.md5("head").alias("digest"))


@query("S4_sniff", "SELECT doc_id, fmt FROM V_blobs")
def s4(v):
    return v.blobs.select("doc_id", N.sniff(F.col("content")).alias("fmt"))


@query("S5_header_dims", """
SELECT doc_id, CAST(CASE WHEN fmt IN ('PNG', 'HDR') THEN n_chars ELSE 0 END AS INT) AS width,
  CAST(CASE WHEN fmt IN ('PNG', 'HDR') THEN doc_id + 1 ELSE 0 END AS INT) AS height FROM V_blobs""")
def s5(v):
    d = N.header_dims(F.col("content"))
    return v.blobs.select("doc_id", d["width"].alias("width"), d["height"].alias("height"))


# ---- containers -----------------------------------------------------------------------------------

def _inventory(v, written=False):
    records = C.inventory_records(D.container_files(v))
    return C.inventory(cut_lineage(records) if written else records)


_RC = "CASE p_type WHEN 'SMALL' THEN 2 WHEN 'LARGE' THEN 3 WHEN 'MEDIUM' THEN 4 ELSE 0 END"


@query("S3_containers", f"""
SELECT {D.PATH_SQL} AS container_id, CASE p_type WHEN 'SMALL' THEN 'other' WHEN 'PROMO' THEN 'chara' ELSE 'clothes' END AS kind,
  CASE WHEN p_type IN ('SMALL', 'PROMO') THEN '' ELSE p_name END AS name, CASE p_type WHEN 'SMALL' THEN '' ELSE '0.0.1' END AS header_version,
  CASE p_type WHEN 'SMALL' THEN '' ELSE '1.2.3' END AS data_version, CASE p_type WHEN 'SMALL' THEN 0 ELSE p_size % 5 END AS n_parts, {_RC} AS rc FROM part""")
def s3a(v):
    c = _inventory(v)["containers"]
    return c.select("container_id", "kind", F.coalesce("name", F.lit("")).alias("name"),
                    F.coalesce("header_version", F.lit("")).alias("header_version"),
                    F.coalesce("data_version", F.lit("")).alias("data_version"), "n_parts", "rc")


_ASSETS = f"""SELECT {D.PATH_SQL} AS container_id, p_partkey * 10 + i AS asset_id, i::INT AS ord,
  CASE i WHEN 0 THEN 'PNG' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'HDR' ELSE 'UNKNOWN' END AS fmt,
  (CASE i WHEN 0 THEN p_size * 128 WHEN 1 THEN p_size * 32 WHEN 2 THEN p_size * 2 ELSE 0 END)::INT AS width,
  (CASE i WHEN 0 THEN p_size * 64 WHEN 1 THEN p_size * 16 WHEN 2 THEN p_size + 2 ELSE 0 END)::INT AS height,
  (strlen(p_name) + CASE i WHEN 0 THEN 29 WHEN 1 THEN 17 WHEN 2 THEN strlen('#?RADIANCE' || chr(10) || 'FORMAT=32-bit_rle_rgbe' || chr(10) || chr(10)
    || '-Y ' || (p_size + i) || ' +X ' || (p_size * 2) || chr(10)) ELSE 4 END)::BIGINT AS n_bytes
  FROM part, range(4) t(i) WHERE i <= p_size % 4 AND p_type NOT IN ('SMALL', 'LARGE', 'MEDIUM')"""


@query("S3_assets", _ASSETS)
def s3b(v):
    return _inventory(v)["assets"].select("container_id", "asset_id", "ord", "fmt", "width", "height", "n_bytes")


@query("S3_bindings", f"""
SELECT {D.PATH_SQL} AS container_id, 0 AS list_no, i::INT AS ord, (i + 1)::INT AS obj_type, (i * 2)::INT AS coord_idx, p_size % 9 AS slot,
  p_name AS material, {_PROP_SQL} AS property, p_partkey * 10 + i AS asset_id FROM part, range(3) t(i)
WHERE i < p_size % 4 AND p_type NOT IN ('SMALL', 'LARGE', 'MEDIUM') UNION ALL
SELECT {D.PATH_SQL}, 1, 0, 4, 6, p_size % 9, p_name, 'LateTex', p_partkey * 10 + 3 FROM part WHERE p_type = 'PROMO'""")
def s3c(v):
    return _inventory(v)["bindings"]


@query("S3_shaders", f"""
SELECT {D.PATH_SQL} AS container_id, 0 AS ord, 1 AS obj_type, p_size % 9 AS slot, p_name AS material, 'main_' || lower(p_type) AS shader,
  'old' AS shader_original FROM part WHERE p_type NOT IN ('SMALL', 'LARGE', 'MEDIUM')""")
def s3d(v):
    return _inventory(v)["shaders"]


@query("R16_verify", f"""
WITH a AS ({_ASSETS}) SELECT {D.PATH_SQL} AS container_id, p_type NOT IN ('SMALL', 'MEDIUM') AS ok,
  CASE p_type WHEN 'LARGE' THEN 'no assets' WHEN 'SMALL' THEN 'structure broken' WHEN 'MEDIUM' THEN 'structure broken'
  ELSE n || ' assets readable' END AS message, coalesce(n, 0) AS n_assets, coalesce(h, 0) AS n_hdr, coalesce(u, 0) AS n_other
FROM part LEFT JOIN (SELECT container_id, count(*) AS n, count(*) FILTER (WHERE fmt = 'HDR') AS h, count(*) FILTER (WHERE fmt = 'UNKNOWN') AS u
  FROM a GROUP BY 1) s ON s.container_id = {D.PATH_SQL}""")
def r16(v):
    inv = _inventory(v, written=True)  # containers and assets: files are walked once
    return O.verify(inv["containers"], inv["assets"])


# ---- rule and preset JSON -----------------------------------------------------------------------------

@query("S6_read_rules", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'keep' ELSE event_type END AS format,
  CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 0 ELSE k END AS size, CASE WHEN event_type = 'signup' THEN k END AS sharpen_pct,
  CASE WHEN event_type = 'purchase' THEN 'cas' END AS sharpen_mode, CASE WHEN event_type IN ('purchase', 'signup') THEN 0 END AS gray_a FROM (
  SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)""")
def s6(v):
    k = F.get_json_object("props", "$.k")
    e = F.col("event_type")
    # wrong types: a numeric format (error), a text size (click), a fractional size (view)
    fmt = F.when(e == "error", F.lit("5")).otherwise(F.concat(F.lit('"'), e, F.lit('"')))
    size = F.when(e == "click", F.concat(F.lit('"'), k, F.lit('"'))).when(e == "view", F.concat(k, F.lit(".5"))).otherwise(k)
    extra = (F.when(e == "signup", F.concat(F.lit(', "sh": '), k, F.lit(', "ga": 0, "shm": 3')))
             .when(e == "purchase", F.lit(', "shm": "cas", "ga": 0, "up": -1, "other": {"a": [1, 2]}')).otherwise(F.lit("")))
    json = F.concat(F.lit('{"format": '), fmt, F.lit(', "size": '), size, extra, F.lit("}"))
    d = rules_json.read_rules(v.events.select("event_id", json.alias("json")), "json")
    return d.select("event_id", "rule.format", "rule.size", "rule.sharpen_pct", "rule.sharpen_mode", "rule.gray_a")


_P7 = "SELECT * FROM part WHERE p_type NOT IN ('SMALL', 'MEDIUM')"


def _presets(v):
    return rules_json.read_presets(C.preset_texts(D.preset_files(v), D.PRESET_MARKER))


@query("S7_presets", f"""
SELECT {D.PRESET_PATH_SQL} AS preset_id, p_brand AS source, CASE p_type WHEN 'PROMO' THEN 'chara' ELSE 'clothes' END AS kind,
  CAST('0.' || (p_size % 10) AS DOUBLE) AS min_match, 's1|' || p_name || ';s2' AS sigs FROM ({_P7})""")
def s7(v):
    return _presets(v)["presets"].select("preset_id", "source", "kind", "min_match", F.array_join("sigs", ";").alias("sigs"))


@query("S7_preset_rules", f"""
SELECT {D.PRESET_PATH_SQL} AS preset_id, CAST(CASE p_type WHEN 'PROMO' THEN 100003 ELSE p_size % 9 END AS VARCHAR) AS target, 'png' AS format,
  CASE WHEN p_size > 40 THEN 0 ELSE p_size * 16 END AS size, 50 AS sharpen_pct, NULL::INT AS gray_a, NULL AS sigs FROM ({_P7}) UNION ALL
SELECT {D.PRESET_PATH_SQL}, CAST(p_partkey AS VARCHAR), 'keep', 64, NULL, 1, 'a|' || p_name FROM ({_P7})""")
def s7b(v):
    p = _presets(v)
    cols = ["rule.format", "rule.size", "rule.sharpen_pct", "rule.gray_a"]
    owners = p["owner_rules"].select("preset_id", F.col("owner_key").cast("string").alias("target"), *cols,
                                     F.lit(None).cast("string").alias("sigs"))
    return owners.unionByName(p["asset_rules"].select("preset_id", F.col("asset_id").alias("target"), *cols,
                                                      F.array_join("sigs", ";").alias("sigs")))


@query("S8_preset_catalog", f"""
SELECT {D.PRESET_PATH_SQL} AS path, CASE WHEN p_size > 25 THEN p_name ELSE p_type || '_' || p_partkey END AS name, p_brand AS source,
  '' AS saved, rank() OVER (ORDER BY lower({D.PRESET_PATH_SQL}), {D.PRESET_PATH_SQL}) AS place FROM ({_P7})""")
def s8(v):
    return with_place(rules_json.preset_catalog(_presets(v)["presets"]), "path")


# ---- sinks ----------------------------------------------------------------------------------------------

@query("K1_output_paths", """
SELECT page_id, 'out/x/x[zip]' || CASE WHEN rel_dir = '' THEN '' ELSE '/' || rel_dir END AS out_dir,
  'out/x/x[zip]' || CASE WHEN rel_dir = '' THEN '' ELSE '/' || rel_dir END || '/' || regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '')
  || '_small.png' AS out_path FROM V_files""")
def k1(v):
    return corpus.output_paths(v.files, corpus.default_output("out/x", True), "_small").select(
        "page_id", "out_dir", "out_path")


@query("K2_rule_json", """
SELECT p_partkey, '{"format":"' || CASE p_type WHEN 'PROMO' THEN 'jpeg' ELSE 'auto' END || '","size":' || p_size
  || CASE WHEN p_size > 25 THEN ',"sh":' || p_size * 2 ELSE '' END || CASE WHEN p_type = 'LARGE' THEN ',"shm":"cas"' ELSE '' END
  || CASE WHEN p_size < 10 THEN ',"ga":1' ELSE '' END || '}' AS json FROM part""")
def k2(v):
    p, t = F.col("p_size"), F.col("p_type")
    r = rule(F.when(t == "PROMO", "jpeg").otherwise("auto"), p, F.when(p > 25, p * 2), F.when(t == "LARGE", "cas"), F.when(p < 10, 1))
    return v.part.select("p_partkey", rules_json.rule_json(r).alias("json"))


@query("K2_plan_json", f"""
SELECT plan_id, '{{' || string_agg('"' || class || '": {{"format":"' || format || '","size":' || size || '}}', ', ' ORDER BY {T.class_ord('class')})
  || '}}' AS json FROM ({PLANS_SQL}) GROUP BY 1""")
def k2b(v):
    return rules_json.plan_json(brand_plans(v))


@query("K2_preset_json", f"""
SELECT CAST(p_partkey AS VARCHAR) AS preset_id, p_brand AS source, 'clothes' AS kind, 's' || p_size AS sigs, p_size % 9 AS owner_key,
  'png' AS owner_format, CAST(p_partkey AS VARCHAR) AS asset_id, {T.sig('1', 'p_name', _PROP_SQL)} AS asset_sig, p_size * 16 AS asset_size
FROM part WHERE p_size > 20 UNION ALL
SELECT CAST(p_partkey AS VARCHAR), p_brand, 'clothes', 's' || p_size, p_size % 9, 'png', CAST(p_partkey AS VARCHAR), NULL, p_size * 16
FROM part WHERE p_size <= 20""")
def k2c(v):
    """One preset per part, written as JSON and read back."""
    pid = F.col("p_partkey").cast("string").alias("preset_id")
    presets = v.part.select(pid, F.col("p_brand").alias("source"), F.lit("clothes").alias("kind"), F.lit(0.5).alias("min_match"),
                            F.array(F.concat(F.lit("s"), "p_size")).alias("sigs"))
    owners = v.part.select(pid, (F.col("p_size") % 9).alias("owner_key"), rule("png", 256, up=2).alias("rule"))
    ar = asset_rules(v).withColumn("preset_id", F.col("asset_id"))
    text = rules_json.preset_json(presets, owners, ar).select(F.col("preset_id").alias("path"), "json")
    back = rules_json.read_presets(text)
    heads = back["presets"].select("preset_id", "source", "kind", F.array_join("sigs", ";").alias("sigs"))
    own = back["owner_rules"].select("preset_id", "owner_key", F.col("rule.format").alias("owner_format"))
    tex = back["asset_rules"].select("preset_id", "asset_id", F.get("sigs", F.lit(0)).alias("asset_sig"),
                                     F.col("rule.size").alias("asset_size"))
    return heads.join(own, "preset_id").join(tex, "preset_id")


@query("K3_outcome_report", f"""
SELECT o.container_id, o.asset_id AS id, {T.class_at(T.class_rank(_PROP_SQL))} AS class, p_size * 128 || 'x' || p_size * 64 AS before,
  p_size * 64 || 'x' || p_size * 32 AS after, raw_bytes AS bytes_in, out_bytes AS bytes_out, fmt, p_type AS mode,
  substr(p_name || ',' || p_brand || ',' || p_type || ',' || p_name || ',' || p_brand || ',' || p_name, 1, 56) AS props
FROM V_outcomes o JOIN part ON p_partkey = o.ord""")
def k3(v):
    from assetlake.functions.classify import class_at, property_rank
    from assetlake.registry.views import property_of_part
    o = O.choose_candidate(v.candidates).join(v.part, F.col("ord") == F.col("p_partkey"))
    p = F.col("p_size")

    def dim(a, b):
        return F.concat((p * a).cast("string"), F.lit("x"), (p * b).cast("string"))
    d = o.select("container_id", "asset_id", class_at(property_rank(property_of_part())).alias("class"), dim(128, 64).alias("before"),
                 dim(64, 32).alias("after"), F.col("raw_bytes").alias("bytes_in"), F.col("out_bytes").alias("bytes_out"), "fmt",
                 F.col("p_type").alias("mode"),
                 F.concat_ws(",", "p_name", "p_brand", "p_type", "p_name", "p_brand", "p_name").alias("props"))
    return sinks.outcome_report(d)


@query("K4_payload_order", """SELECT container_id, ord, asset_id, out_bytes,
  rank() OVER (ORDER BY container_id, ord) AS place FROM V_outcomes""")
def k4(v):
    rows = sinks.payload_order(O.choose_candidate(v.candidates)).select("container_id", "ord", "asset_id", "out_bytes")
    return with_place(rows, "container_id", "ord")


# ---- incremental -------------------------------------------------------------------------------------------

@query("I1_new_files", """
SELECT page_id FROM V_files f WHERE NOT EXISTS (SELECT 1 FROM (SELECT path, CASE WHEN event_type = 'view' THEN mtime + INTERVAL 1 SECOND ELSE mtime END AS mtime,
  CASE WHEN event_type = 'error' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM V_files JOIN events ON event_id = page_id WHERE event_type <> 'signup') m
  WHERE m.path = f.path AND m.mtime = f.mtime AND m.n_chars = f.n_chars)""")
def i1(v):
    ident = ["path", "mtime", "n_chars"]
    e = F.col("event_type")
    known = v.files.join(v.events.select("event_id", "event_type"), F.col("event_id") == F.col("page_id")).where("event_type <> 'signup'")
    manifest = known.select("path", F.when(e == "view", F.col("mtime") + F.expr("interval 1 second")).otherwise(F.col("mtime")).alias("mtime"),
                            F.when(e == "error", F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"))
    return I.new_files(v.files, manifest, ident).select("page_id")


_LISTED = """one AS (SELECT path || '#' || page_id AS path, mtime, n_chars AS length FROM V_files),
two AS (SELECT path || '#' || page_id AS path, CASE WHEN event_type = 'view' THEN mtime + INTERVAL 1 SECOND ELSE mtime END AS mtime,
  CASE WHEN event_type = 'error' THEN n_chars + 1 ELSE n_chars END AS length FROM V_files JOIN events ON event_id = page_id WHERE event_type <> 'signup')"""


@query("I1_stream_arrivals", f"""
WITH {_LISTED}, a AS (SELECT *, CASE WHEN length % 7 = 3 THEN 2 ELSE 0 END AS rc FROM one),
todo AS (SELECT a.path, coalesce(two.mtime, a.mtime) AS mtime, coalesce(two.length, a.length) AS length FROM a LEFT JOIN two USING (path)
  WHERE rc = 2 OR two.mtime <> a.mtime OR two.length <> a.length),
b AS (SELECT *, CASE WHEN length % 11 = 5 THEN 4 ELSE 0 END AS rc FROM todo)
SELECT path, length, rc, CAST(0 AS INT) AS batch_id FROM a UNION ALL SELECT path, length, rc, 1 FROM b UNION ALL
SELECT path, length, 0, 2 FROM b WHERE rc = 4""")
def i1_stream(v):
    """Two listings of the corpus, the second without some files and with others changed, and a third run without any: only
    what is new, changed or failed before is scanned."""
    import os
    import uuid

    from assetlake.session import cut_lineage, shared_dir
    home = os.path.join(shared_dir(v.spark), "arrivals-" + uuid.uuid4().hex)
    one = v.files.select(F.concat_ws("#", "path", "page_id").alias("path"), F.col("mtime").alias("modificationTime"), F.col("n_chars").cast("long").alias("length"), "page_id")
    one = cut_lineage(one)  # both listings come from it: pages are read once
    e = F.col("event_type")
    two = one.join(v.events.select("event_id", "event_type"), F.col("event_id") == F.col("page_id")).where("event_type <> 'signup'").select(
        "path", F.when(e == "view", F.col("modificationTime") + F.expr("interval 1 second")).otherwise(F.col("modificationTime")).alias("modificationTime"),
        (F.col("length") + (e == "error").cast("long")).alias("length"))

    def run(fails, code):
        listing = v.spark.readStream.schema("path string, modificationTime timestamp, length long").option("recursiveFileLookup", "true").parquet(home + "/listings")
        rc = F.when(fails, code).otherwise(0)
        I.scan_arrivals(listing, lambda d: d.withColumn("rc", rc), home + "/scans", home + "/checkpoint")
    one.drop("page_id").write.parquet(home + "/listings/1")
    run(F.col("length") % 7 == 3, 2)
    two.write.parquet(home + "/listings/2")
    run(F.col("length") % 11 == 5, 4)
    run(F.lit(False), 2)
    return I.outcomes(v.spark, home + "/scans").select("path", "length", "rc", "batch_id")


@query("I2_running_totals", """
SELECT event_type AS class, count(*) AS n_assets, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS n_bytes,
  CAST(max(user_id) AS BIGINT) AS max_dim FROM events GROUP BY 1""")
def i2(v):
    """The events table drained as a stream into the running totals."""
    import os
    import uuid

    from assetlake.session import shared_dir
    home = os.path.join(shared_dir(v.spark), "totals-" + uuid.uuid4().hex)
    path = f"{v.dir}/events.parquet"
    src = v.spark.readStream.schema(v.events.schema).option("pathGlobFilter", "events.parquet").parquet(os.path.dirname(path))
    rows = src.select(F.col("event_type").alias("class"), F.round(F.col("value") * 100).cast("long").alias("n_bytes"),
                      F.col("user_id").alias("dim"))
    I.drain(I.running_totals(rows), home + "/checkpoint", home + "/totals")
    return I.read_totals(v.spark, home + "/totals")


@query("I2_batch_equals_stream", """
SELECT class, count(*) AS n_assets, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, max(dim) AS max_dim FROM V_classed GROUP BY 1""")
def i2b(v):
    return I.running_totals(S.classed(v.assets, v.bindings))
