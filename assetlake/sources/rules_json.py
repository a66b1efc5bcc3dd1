"""Rule, plan and preset JSON. Unknown fields are ignored, a field of the wrong type is
its default, a missing optional field means "follow"."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.functions.classify import class_ord
from assetlake.functions.rules import rule

def rule_of(v: Column) -> Column:
    """Rule struct from variant-typed JSON: ``v`` is a VariantType column holding one rule object."""
    def text(name):
        f = F.try_variant_get(v, "$." + name, "variant")
        return F.when(F.schema_of_variant(f) == "STRING", F.try_variant_get(v, "$." + name, "string"))

    def number(name):
        f = F.try_variant_get(v, "$." + name, "variant")
        whole = F.schema_of_variant(f).isin("BIGINT", "INT", "SMALLINT", "TINYINT")
        return F.when(whole, F.try_variant_get(v, "$." + name, "int"))

    def follow(c):
        return F.when(c >= 0, c)
    mode = text("shm")
    return rule(F.coalesce(text("format"), F.lit("keep")), F.coalesce(number("size"), F.lit(0)),
                follow(number("sh")), F.when(mode != "", mode), follow(number("ga")), follow(number("up")))


def _variant(c) -> Column:
    return F.try_parse_json(F.col(c) if isinstance(c, str) else c)


def read_rules(df: DataFrame, json_col: str) -> DataFrame:
    """A JSON column with one rule object per row -> rule."""
    return df.withColumn("rule", rule_of(_variant(json_col)))


def rules_map(df: DataFrame, json_col: str, key: str) -> DataFrame:
    """A JSON column {key: rule object, ...} -> one row per entry (key, rule)."""
    m = F.from_json(F.col(json_col), "map<string,variant>")
    keep = [c for c in df.columns if c != json_col]
    rows = df.select(*keep, F.explode(m).alias(key, "_v"))
    return rows.withColumn("rule", rule_of(F.col("_v"))).drop("_v")


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """Plan files ({class: rule}) -> plan_id (the file), class, ord, rule."""
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("plan_id"))
    out = rules_map(texts, "value", "class")
    return out.select("plan_id", "class", class_ord(F.col("class")).alias("ord"), "rule")


def read_presets(texts: DataFrame) -> dict:
    """Path, json -> presets, owner_rules, asset_rules. R15 applies: a preset with a group x slot key
    is for grouped containers even when its kind field is missing."""
    src = texts.where("json is not null").select(F.col("path").alias("preset_id"), "json", _variant("json").alias("v"))
    src = src.where("v is not null")

    def text(name):
        f = F.try_variant_get("v", "$." + name, "variant")
        return F.when(F.schema_of_variant(f) == "STRING", F.try_variant_get("v", "$." + name, "string"))
    fields = F.from_json("json", "map<string,string>")
    parts = F.from_json(F.col("json"), "struct<parts:map<string,variant>>")["parts"]
    tex = F.from_json(F.col("json"), "struct<textures:array<variant>>")["textures"]
    sigs = F.from_json(F.col("json"), "struct<sigs:array<string>>")["sigs"]
    group_keys = F.exists(F.map_keys(parts), lambda k: k.try_cast("int") >= 100000)
    kind = F.when((F.lower(text("cardType")) == "chara") | F.coalesce(group_keys, F.lit(False)),
                  F.lit("chara")).otherwise(F.lit("clothes"))
    uniform = F.try_variant_get("v", "$.uniform", "variant")
    presets = src.select(
        "preset_id", F.coalesce(text("source"), F.lit("")).alias("source"), F.coalesce(text("name"), F.lit("")).alias("name"),
        F.coalesce(text("saved"), F.lit("")).alias("saved"), kind.alias("kind"),
        F.coalesce(F.try_variant_get("v", "$.minMatch", "double"), F.lit(0.5)).alias("min_match"),
        F.when(F.schema_of_variant(uniform).startswith("OBJECT"), rule_of(uniform)).alias("uniform"),
        F.coalesce(sigs, F.array().cast("array<string>")).alias("sigs"), fields.alias("settings"))
    owner_rules = src.select("preset_id", F.explode(parts).alias("_k", "_v")).select(
        "preset_id", F.col("_k").try_cast("int").alias("owner_key"), rule_of(F.col("_v")).alias("rule")
    ).where("owner_key is not null")
    rows = src.select("preset_id", F.posexplode(tex).alias("rule_no", "_v"))
    ids = F.try_variant_get("_v", "$.id", "variant")
    asset_rules = rows.select(
        "preset_id", "rule_no",
        F.when(F.schema_of_variant(ids) == "STRING", F.try_variant_get("_v", "$.id", "string")).otherwise(F.lit(""))
        .alias("asset_id"),
        F.coalesce(F.try_variant_get("_v", "$.sigs", "array<string>"), F.array().cast("array<string>")).alias("sigs"),
        rule_of(F.col("_v")).alias("rule"))
    return {"presets": presets, "owner_rules": owner_rules, "asset_rules": asset_rules}


def preset_catalog(presets: DataFrame) -> DataFrame:
    """Display name (JSON name, else file name without '[preset]'), source and save time, in
    case-insensitive order of the path."""
    stem = F.regexp_replace(F.regexp_extract("preset_id", r"([^/]*)\z", 1), r"\.[^.]*\z", "")
    shown = F.when(F.col("name") != "", F.col("name")).otherwise(F.regexp_replace(stem, r"(?i)^\[preset\]", ""))
    return presets.select(F.col("preset_id").alias("path"), shown.alias("name"), "source", "saved").orderBy(
        F.lower("path"), "path")


def rule_json(r: Column, id_cols=()) -> Column:
    """K2: rule object; fields that follow the global setting are left out."""
    cols = [F.col(c).alias(c) for c in id_cols]
    return F.to_json(F.struct(
        *cols, r["format"].alias("format"), r["size"].alias("size"), r["sharpen_pct"].alias("sh"),
        r["sharpen_mode"].alias("shm"), r["gray_a"].alias("ga"), r["up"].alias("up")), {"ignoreNullFields": "true"})


def plan_json(plan: DataFrame, by=("plan_id",)) -> DataFrame:
    """K2: one JSON object per plan, classes in report order (at most nine entries)."""
    entry = F.struct("ord", F.concat(F.lit('"'), F.col("class"), F.lit('": '), rule_json(F.col("rule"))).alias("t"))
    out = plan.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    body = F.array_join(F.transform("_e", lambda e: e["t"]), ", ")
    return out.select(*by, F.concat(F.lit("{"), body, F.lit("}")).alias("json"))


def preset_rule_lines(owner_rules: DataFrame) -> DataFrame:
    """K2: owner rules of presets as JSON lines (preset_id, owner_key, json), the form that scales: one
    line per rule, so no preset is gathered into one row."""
    return owner_rules.select("preset_id", "owner_key", rule_json(F.col("rule")).alias("json"))


def preset_json(presets: DataFrame, owner_rules: DataFrame, asset_rules: DataFrame) -> DataFrame:
    """K2: the single-file form read_presets takes. One preset is one small file by definition: its
    entries are gathered per preset, never across presets, where its rows lie together: lists gathered before that would only
    fill the memory of the task that reads them."""
    n = int(presets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    presets, owner_rules, asset_rules = (df.repartition(n, "preset_id") for df in (presets, owner_rules, asset_rules))
    part = F.struct("owner_key", F.concat(F.lit('"'), F.col("owner_key").cast("string"), F.lit('": '),
                                          rule_json(F.col("rule"))).alias("t"))
    parts = owner_rules.groupBy("preset_id").agg(F.array_sort(F.collect_list(part)).alias("_p"))
    flat = asset_rules.select("preset_id", "rule_no", F.to_json(F.struct(
        F.col("asset_id").alias("id"), "sigs", F.col("rule.format").alias("format"), F.col("rule.size").alias("size"),
        F.col("rule.sharpen_pct").alias("sh"), F.col("rule.sharpen_mode").alias("shm"),
        F.col("rule.gray_a").alias("ga"), F.col("rule.up").alias("up")), {"ignoreNullFields": "true"}).alias("t"))
    tex = flat.groupBy("preset_id").agg(F.array_sort(F.collect_list(F.struct("rule_no", "t"))).alias("_t"))
    j = presets.join(parts, "preset_id", "left").join(tex, "preset_id", "left")

    def joined(c):
        return F.coalesce(F.array_join(F.transform(c, lambda e: e["t"]), ", "), F.lit(""))
    head = F.to_json(F.struct("source", F.col("kind").alias("cardType"), F.col("min_match").alias("minMatch"), "sigs"))
    return j.select("preset_id", F.concat(
        F.substring(head, F.lit(1), F.length(head) - 1), F.lit(', "parts": {'), joined("_p"), F.lit('}, "textures": ['),
        joined("_t"), F.lit("]}")).alias("json"))
