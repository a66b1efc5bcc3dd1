"""Stand-in views over the given tables: the same relations in Spark and as oracle SQL."""
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.functions import keys
from assetlake.registry import sqltext as T
from assetlake.schemas import RULE

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

PROPERTY_OF_NOUN = {"ring": "AlphaMask", "plate": "NormalMap", "bolt": "BumpMap", "gear": "ParallaxMap",
                    "widget": "MainTex", "rod": "EmissionMask", "gizmo": "MatCapTex"}
_PROP_SQL = "CASE split_part(p_name, ' ', 2) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in PROPERTY_OF_NOUN.items()) + " ELSE 'DetailTex' END"

OWNER_BASES = (0, 1000, 2000)
# owner rules of the stand-in, for every kind of owner: slot -> (format, size, sharpen_pct, sharpen_mode, gray_a, up); slot 7 has none
SLOT_RULES = {1: ("png", 512, 50, "cas", 1, 2), 2: ("auto", 1024, 100, "cas", 1, 2), 3: ("jpeg", 2048, 80, "edge", 0, 4),
              4: ("keep", 0, None, None, None, None), 5: ("auto", 0, 100, "cas", 1, None),
              6: ("jpeg", 512, None, "cas", 1, 0)}


def _case(col, values, i):
    def lit(v):
        return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v))
    return f"CASE {col} " + " ".join(f"WHEN {k} THEN {lit(v[i])}" for k, v in values.items()) + " END"


CTES = {
    "V_base": f"""SELECT l_suppkey AS container_id, l_partkey AS asset_id, l_orderkey AS ord, l_linenumber AS slot,
      CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END AS obj_type,
      CAST(round(l_tax * 100) AS INT) - 1 AS coord_idx,
      p_name || CASE WHEN l_quantity > 25 THEN '.MECopy' || CAST(l_linenumber AS VARCHAR) ELSE '' END AS material,
      {_PROP_SQL} AS property, l_discount AS disc, p_size * 128 AS dim,
      CAST(round(p_retailprice * 100) AS BIGINT) AS n_bytes, p_type
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "V_assets": """SELECT DISTINCT container_id, asset_id, n_bytes, dim, dim AS width, dim - 64 AS height,
      p_type <> 'PROMO' AS flat_alpha, p_type = 'PROMO' AND dim > 3000 AS circle_only, p_type FROM V_base""",
    "V_bindings": """SELECT container_id, asset_id, ord, obj_type, coord_idx, slot, material, property,
      CASE WHEN obj_type = 2 THEN 1000 + slot WHEN obj_type >= 3 THEN 2000 + slot ELSE slot END AS owner_key
      FROM V_base WHERE disc > 0.02""",
    "V_gbindings": """SELECT container_id, asset_id, ord, obj_type, coord_idx, slot, material, property,
      owner_key AS slot_key, CASE WHEN obj_type >= 3 OR coord_idx < 0 THEN 0 ELSE coord_idx + 1 END AS group_no,
      ((CASE WHEN obj_type >= 3 OR coord_idx < 0 THEN 0 ELSE coord_idx + 1 END) + 1) * 100000 + owner_key AS owner_key
      FROM V_bindings""",
    "V_owner_rules": f"""SELECT base + slot AS owner_key, {_case('slot', SLOT_RULES, 0)} AS format,
      {_case('slot', SLOT_RULES, 1)} AS size, {_case('slot', SLOT_RULES, 2)} AS sharpen_pct,
      {_case('slot', SLOT_RULES, 3)} AS sharpen_mode, {_case('slot', SLOT_RULES, 4)} AS gray_a,
      {_case('slot', SLOT_RULES, 5)} AS up FROM (VALUES {', '.join(f'({b})' for b in OWNER_BASES)}) b(base),
      (VALUES {', '.join(f'({s})' for s in SLOT_RULES)}) s(slot)""",
    "V_shaders": """SELECT l_suppkey AS container_id, l_orderkey AS ord, l_linenumber AS slot,
      CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END AS obj_type, p_name AS material,
      CASE WHEN l_tax > 0.07 THEN '' WHEN l_tax > 0.05 THEN 'Main_Alpha/' || p_type ELSE 'main_opaque/' || p_brand END
      AS shader FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "V_asset_class": f"""SELECT container_id, asset_id, min({T.class_rank('property')}) AS class_rank,
      {T.class_at('min(' + T.class_rank('property') + ')')} AS class, bool_or({T.risky('property')}) AS risky,
      count(DISTINCT owner_key) AS n_owners, min(owner_key) AS min_owner FROM V_bindings GROUP BY ALL""",
    "V_classed": """SELECT a.*, coalesce(c.class, 'other') AS class FROM V_assets a
      LEFT JOIN V_asset_class c USING (container_id, asset_id)""",
    "V_class_stats": """SELECT container_id, class, count(*) AS n_assets, CAST(sum(n_bytes) AS BIGINT) AS n_bytes,
      max(dim) AS max_dim FROM V_classed GROUP BY ALL""",
    "V_parts": """SELECT b.container_id, b.owner_key, count(*) AS n_assets, CAST(sum(a.n_bytes) AS BIGINT) AS n_bytes,
      count(*) FILTER (WHERE n.k = 1) AS own_count,
      CAST(coalesce(sum(a.n_bytes) FILTER (WHERE n.k = 1), 0) AS BIGINT) AS own_bytes
      FROM (SELECT DISTINCT container_id, asset_id, owner_key FROM V_bindings) b
      JOIN V_assets a USING (container_id, asset_id)
      JOIN (SELECT container_id, asset_id, count(DISTINCT owner_key) AS k FROM V_bindings GROUP BY ALL) n
      USING (container_id, asset_id) GROUP BY ALL""",
    "V_gparts": """SELECT b.container_id, b.owner_key, count(*) AS n_assets, CAST(sum(a.n_bytes) AS BIGINT) AS n_bytes
      FROM (SELECT DISTINCT container_id, asset_id, owner_key FROM V_gbindings) b
      JOIN V_assets a USING (container_id, asset_id) GROUP BY ALL""",
    "V_asset_sigs": f"""SELECT DISTINCT container_id, asset_id, {T.sig('owner_key', 'material', 'property')} AS sig
      FROM V_bindings""",
    "V_csigs": "SELECT DISTINCT container_id, sig FROM V_asset_sigs",
    "V_preset_sigs": f"""SELECT DISTINCT p_brand AS preset_id, {T.sig('l_linenumber', "p_name || CASE WHEN l_quantity > 48 THEN ' old' ELSE '' END", _PROP_SQL)} AS sig
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "V_containers": """SELECT o_orderkey AS container_id, CAST(round(o_totalprice * 100) AS BIGINT) AS n_bytes_before,
      CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 3 ELSE 6 END AS rc, o_custkey AS root_id, o_orderdate AS mtime,
      o_orderpriority AS priority FROM orders""",
    "V_candidates": """SELECT l_orderkey AS container_id, l_linenumber AS asset_id, l_partkey AS ord, l_suppkey AS supp,
      CAST(round(l_extendedprice * 100) AS BIGINT) * 100 AS raw_bytes,
      CAST(round(l_extendedprice * 100) AS BIGINT) * (120 - 5 * CAST(round(l_discount * 100) AS BIGINT)) AS png_bytes,
      CAST(round(l_extendedprice * 100) AS BIGINT) * (90 + 5 * CAST(round(l_tax * 100) AS BIGINT)) AS jpeg_bytes,
      CAST(round(l_extendedprice * 100) AS BIGINT) * (108 - CAST(l_quantity AS BIGINT)) AS raw_opt_bytes,
      CAST(round(l_extendedprice * 100) AS BIGINT) * (121 - 5 * CAST(round(l_discount * 100) AS BIGINT) - l_linenumber)
      AS png_opt_bytes, l_linestatus = 'O' AS auto_mode, l_returnflag <> 'R' AS use_jpeg,
      l_quantity > 45 AS upscaled, CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 'JPEG' ELSE 'PNG' END AS raw_fmt
      FROM lineitem""",
    "V_outcomes": """SELECT *, CASE WHEN picked = 'raw' THEN (CASE WHEN raw_opt_bytes < raw_bytes THEN raw_fmt || '*'
      ELSE 'orig' END) WHEN picked = 'jpeg' THEN 'JPEG' ELSE 'PNG' END AS fmt,
      CASE WHEN picked = 'raw' THEN least(raw_opt_bytes, raw_bytes) WHEN picked = 'jpeg' THEN jpeg_bytes
      ELSE least(png_opt_bytes, png_bytes) END AS out_bytes,
      (picked = 'png' AND png_opt_bytes < png_bytes)
      OR (picked = 'raw' AND raw_fmt = 'PNG' AND raw_opt_bytes < raw_bytes) AS packed FROM (
      SELECT *, CASE WHEN NOT upscaled AND coded >= raw_bytes THEN 'raw' WHEN takes_jpeg THEN 'jpeg' ELSE 'png' END
      AS picked FROM (SELECT *, CASE WHEN takes_jpeg THEN jpeg_bytes ELSE png_bytes END AS coded FROM (
      SELECT *, use_jpeg AND NOT (auto_mode AND jpeg_bytes >= png_bytes) AS takes_jpeg FROM V_candidates)))""",
    "V_files": """SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path, length(html) AS n_chars,
      regexp_extract(url, '^https?://[^/]+/([^/?#]+)/', 1) AS rel_dir, ts AS mtime FROM pages JOIN events
      ON page_id = event_id""",
    "V_grid": """SELECT vec_id AS img_id, (i // 8)::INT AS y, (i % 8)::INT AS x,
      CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS INT) AS v, label FROM (
      SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)""",
    "V_pixels": """SELECT img_id, y, x, v AS r, CASE WHEN label % 2 = 0 THEN v ELSE (v * 3) % 256 END AS g,
      CASE WHEN label % 2 = 0 THEN v ELSE 255 - v END AS b,
      CASE label % 3 WHEN 0 THEN 255 WHEN 1 THEN 127 ELSE v END AS a, label FROM V_grid""",
    "V_mosaic": """SELECT (vec_id // 50)::BIGINT AS img_id, (vec_id % 50)::INT AS y, i::INT AS x,
      CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS INT) AS v FROM (
      SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)""",
    "V_canvas": """SELECT (vec_id // 32)::INT AS y, (vec_id % 32 * 64 + i)::INT AS x, v AS r, (v * 3) % 256 AS g, 255 - v AS b,
      CASE WHEN i % 2 = 0 THEN 255 ELSE v END AS a FROM (SELECT *, CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS INT) AS v FROM (
      SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))""",
    "V_blobs": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'PNG' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'HDR'
      WHEN 3 THEN 'EXR' ELSE 'UNKNOWN' END AS fmt, n_chars, text FROM documents""",
}


def _noun():
    return F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))


def property_of_part():
    out = F.lit("DetailTex")
    for k, v in PROPERTY_OF_NOUN.items():
        out = F.when(_noun() == k, F.lit(v)).otherwise(out)
    return out


def cents(c):
    return F.round(F.col(c) * 100).cast("long")


def obj_type():
    return F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(4)


_FACTS = {}


class Views:
    """Lazy stand-in views for one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.tables = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self.tables[name]

    def __getattr__(self, name):
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def spread_part(self):
        """The part table dealt over tasks: a whole row group is one task otherwise, and each row becomes a file."""
        return self.part.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")

    @cached_property
    def lines(self):
        """What a line has from its part alone, ``property``, is made once a part, before the join."""
        return self.lineitem.join(self.part.withColumn("property", property_of_part()), F.col("l_partkey") == F.col("p_partkey"))

    @cached_property
    def base(self):
        copy = F.when(F.col("l_quantity") > 25, F.concat(F.lit(".MECopy"), F.col("l_linenumber"))).otherwise("")
        return self.lines.select(
            F.col("l_suppkey").alias("container_id"), F.col("l_partkey").alias("asset_id"),
            F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("slot"), obj_type().alias("obj_type"),
            (F.round(F.col("l_tax") * 100).cast("int") - 1).alias("coord_idx"),
            F.concat("p_name", copy).alias("material"), "property",
            F.col("l_discount").alias("disc"), (F.col("p_size") * 128).alias("dim"), cents("p_retailprice").alias("n_bytes"),
            "p_type")

    def _asset_rows(self, repeated):
        promo = F.col("p_type") == "PROMO"
        rows = self.base.select("container_id", "asset_id", "n_bytes", "dim", "p_type")
        # size, edges and type depend on the asset id, so one row per key is the distinct row
        return (rows if repeated else rows.dropDuplicates(["container_id", "asset_id"])).select(
            "container_id", "asset_id", "n_bytes", "dim", F.col("dim").alias("width"), (F.col("dim") - 64).alias("height"),
            (~promo).alias("flat_alpha"), (promo & (F.col("dim") > 3000)).alias("circle_only"), "p_type")

    @cached_property
    def assets(self):
        return self._asset_rows(False)

    @cached_property
    def bindings(self):
        return self.base.where("disc > 0.02").select(
            "container_id", "asset_id", "ord", "obj_type", "coord_idx", "slot", "material", "property",
            keys.owner_key(F.col("obj_type"), F.col("slot")).alias("owner_key"))

    @property
    def facts(self):
        """Assets and bindings in the co-partitioned store, written once for a session and directory."""
        from assetlake.operators.facts import write_facts
        key = (self.spark.sparkContext.applicationId, self.dir, self.spark.conf.get("spark.sql.shuffle.partitions"))
        if key not in _FACTS:
            _FACTS[key] = write_facts(self._asset_rows(True), self.bindings, repeated=True)
        return _FACTS[key]

    @cached_property
    def gbindings(self):
        return self.grouped(self.bindings)

    @staticmethod
    def grouped(bindings):
        g = keys.group_of(F.col("obj_type"), F.col("coord_idx"))
        return bindings.withColumn("group_no", g).withColumn("slot_key", F.col("owner_key")).withColumn(
            "owner_key", keys.pack_group(F.col("group_no"), F.col("slot_key")))

    @cached_property
    def owner_rules(self):
        from assetlake.operators.resolve import literal_rows
        names = ("format", "size", "sharpen_pct", "sharpen_mode", "gray_a", "up")
        return literal_rows(self.spark, [
            {"owner_key": base + slot, "rule": dict(zip(names, values))}
            for base in OWNER_BASES for slot, values in SLOT_RULES.items()], f"owner_key:int,rule:{RULE}")

    @cached_property
    def shaders(self):
        name = (F.when(F.col("l_tax") > 0.07, F.lit("")).when(F.col("l_tax") > 0.05, F.concat(F.lit("Main_Alpha/"), "p_type"))
                .otherwise(F.concat(F.lit("main_opaque/"), "p_brand")))
        return self.lines.select(
            F.col("l_suppkey").alias("container_id"), F.col("l_orderkey").alias("ord"),
            F.col("l_linenumber").alias("slot"), obj_type().alias("obj_type"), F.col("p_name").alias("material"),
            name.alias("shader"))

    @cached_property
    def preset_bindings(self):
        """A preset for each brand, from all its lines; some carry a material that no container has any more. With repeats."""
        return self._preset_rows(self._preset_lines)

    @cached_property
    def _preset_lines(self):
        return self.lines.select("p_brand", "p_name", "l_linenumber", (F.col("l_quantity") > 48).alias("_old"))

    def _preset_rows(self, lines):
        from assetlake.functions.text import signature
        name = F.concat("p_name", F.when(F.col("_old"), " old").otherwise(""))
        return lines.select(F.col("p_brand").alias("preset_id"), signature(F.col("l_linenumber"), name, property_of_part()).alias("sig"))

    @cached_property
    def preset_sigs(self):
        """Lines become distinct before their signatures are made."""
        return self._preset_rows(self._preset_lines.distinct()).distinct()

    @cached_property
    def containers(self):
        rc = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 3).otherwise(6)
        return self.orders.select(
            F.col("o_orderkey").alias("container_id"), cents("o_totalprice").alias("n_bytes_before"), rc.alias("rc"),
            F.col("o_custkey").alias("root_id"), F.col("o_orderdate").alias("mtime"), F.col("o_orderpriority").alias("priority"))

    @cached_property
    def candidates(self):
        price, disc, tax = cents("l_extendedprice"), cents("l_discount"), cents("l_tax")
        return self.lineitem.select(
            F.col("l_orderkey").alias("container_id"), F.col("l_linenumber").alias("asset_id"),
            F.col("l_partkey").alias("ord"), F.col("l_suppkey").alias("supp"),
            (price * 100).alias("raw_bytes"), (price * (F.lit(120) - 5 * disc)).alias("png_bytes"),
            (price * (F.lit(90) + 5 * tax)).alias("jpeg_bytes"),
            (price * (F.lit(108) - F.col("l_quantity").cast("long"))).alias("raw_opt_bytes"),
            (price * (F.lit(121) - 5 * disc - F.col("l_linenumber"))).alias("png_opt_bytes"),
            (F.col("l_linestatus") == "O").alias("auto_mode"), (F.col("l_returnflag") != "R").alias("use_jpeg"),
            (F.col("l_quantity") > 45).alias("upscaled"),
            F.when(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp"), "JPEG").otherwise("PNG").alias("raw_fmt"))

    @cached_property
    def files(self):
        j = self.pages.join(self.events, F.col("page_id") == F.col("event_id"))
        return j.select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"), F.length("html").alias("n_chars"),
                        F.regexp_extract("url", "^https?://[^/]+/([^/?#]+)/", 1).alias("rel_dir"), F.col("ts").alias("mtime"))

    def _cells(self):
        e = self.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("i", "e"))
        v = F.floor((F.col("e").cast("double") + 1) * 127.5).cast("int")
        return e.withColumn("v", v)

    @cached_property
    def grid(self):
        return self._cells().select(F.col("vec_id").alias("img_id"), F.floor(F.col("i") / 8).cast("int").alias("y"),
                                    (F.col("i") % 8).alias("x"), "v", "label")

    @cached_property
    def pixels(self):
        v, odd = F.col("v"), F.col("label") % 2 != 0
        a = F.when(F.col("label") % 3 == 0, 255).when(F.col("label") % 3 == 1, 127).otherwise(v)
        return self.grid.select("img_id", "y", "x", v.alias("r"), F.when(odd, (v * 3) % 256).otherwise(v).alias("g"),
                                F.when(odd, 255 - v).otherwise(v).alias("b"), a.alias("a"), "label")

    @cached_property
    def px(self):
        """With the sizes a pixel table should carry: then no operator has to find them by a join on the image."""
        return self.pixels.drop("label").withColumns({"width": F.lit(8), "height": F.lit(8)})

    @cached_property
    def mosaic(self):
        """Images of 64 columns and up to 50 rows: 50 consecutive vectors stacked."""
        from assetlake.operators.tiles import with_sizes
        v = F.col("v")
        return with_sizes(self._cells().select(
            F.floor(F.col("vec_id") / 50).alias("img_id"), (F.col("vec_id") % 50).cast("int").alias("y"),
            F.col("i").alias("x"), v.alias("r"), v.alias("g"), v.alias("b"), F.lit(255).alias("a")))

    @cached_property
    def canvas(self):
        """One image of all vectors, 2,048 columns wide: 32 vectors side by side in each row."""
        v, i = F.col("v"), F.col("i")
        height = self.embeddings.agg((F.floor(F.max("vec_id") / 32) + 1).cast("int")).scalar()
        return self._cells().select(
            F.floor(F.col("vec_id") / (1 << 40)).cast("int").alias("img_id"), F.floor(F.col("vec_id") / 32).cast("int").alias("y"), ((F.col("vec_id") % 32) * 64 + i).cast("int").alias("x"),
            v.alias("r"), ((v * 3) % 256).alias("g"), (255 - v).alias("b"), F.when(i % 2 == 0, 255).otherwise(v).alias("a"),
            F.lit(2048).alias("width"), height.alias("height"))

    @cached_property
    def blobs(self):
        """Payload bytes out of documents: a real header per format, then the whole text."""
        be = lambda c: F.lpad(F.hex(c), 8, "0")
        png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(F.col("n_chars")), be(F.col("doc_id") + 1),
                               F.lit("0806000000")))
        hdr = F.encode(F.format_string("#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y %d +X %d\n", F.col("doc_id") + 1, F.col("n_chars")),
                       "utf-8")
        n = F.col("doc_id") % 5
        lead = (F.when(n == 0, png).when(n == 1, F.unhex(F.lit("FFD8FFE0"))).when(n == 2, hdr)
                .when(n == 3, F.unhex(F.lit("762F3101"))).otherwise(F.lit(b"")))
        return self.documents.select("doc_id", "n_chars", F.concat(lead, F.encode("text", "utf-8")).alias("content"))
