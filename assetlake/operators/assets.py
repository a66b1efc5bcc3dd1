"""Per-asset facts out of bindings: J1-J4, A4-A6, and the single pass behind R1/R2."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.functions import classify as C
from assetlake.functions import keys, text
from assetlake.functions.rules import format_rank, rule
from assetlake.schemas import ASSET_KEY


def with_owner_key(bindings: DataFrame, grouped: bool = False) -> DataFrame:
    """Add owner_key; grouped containers use group x slot keys."""
    key = keys.owner_key(F.col("obj_type"), F.col("slot"))
    if grouped:
        key = keys.pack_group(keys.group_of(F.col("obj_type"), F.col("coord_idx")), key)
    return bindings.withColumn("owner_key", key)


def _first_list(df: DataFrame, col):
    """Properties count only from the first binding list of a container, where lists are numbered."""
    return F.when(F.col("list_no") == 0, col) if "list_no" in df.columns else col


def asset_profile(bindings: DataFrame, owner_rules: DataFrame = None, mask: int = 0, only=None,
                  with_owners: bool = False, runs: DataFrame = None) -> DataFrame:
    """Everything rule resolution needs to know about an asset, in one exchange on its key.

    All aggregates ignore duplicates and combine on the map side, so a hot asset costs one small
    partial row per task. Columns: class_rank, class, risky, min_owner, max_owner, exclusive and, when
    asked for, only_hit, off_mask, owners, the merged owner rule (R2) with blockers."""
    b = bindings
    prop = F.col("property")
    aggs = [
        F.min(_first_list(b, C.property_rank(prop))).alias("class_rank"),
        F.max(_first_list(b, C.risky_property(prop))).alias("risky"),
        F.min("owner_key").alias("min_owner"), F.max("owner_key").alias("max_owner"),
    ]
    if only:
        aggs.append(F.max(_first_list(b, C.only_hit(prop, only))).alias("only_hit"))
    if mask:
        bad = ~keys.group_in_mask(keys.key_group(F.col("owner_key")), F.lit(mask))
        aggs.append(F.max(bad).alias("off_mask"))
    if with_owners:
        aggs.append(F.array_sort(F.collect_set("owner_key")).alias("owners"))
    if owner_rules is not None:
        b = with_owner_rule(b, owner_rules, runs)
        aggs += _merge_aggs()
    out = b.groupBy(*ASSET_KEY).agg(*aggs)
    out = out.withColumn("class", C.class_at(F.col("class_rank")))
    out = out.withColumn("exclusive", F.col("min_owner") == F.col("max_owner"))
    return _finish_merge(out) if owner_rules is not None else out


def with_owner_rule(b: DataFrame, owner_rules: DataFrame, runs: DataFrame = None) -> DataFrame:
    """Bindings with the rule of their owner (_r), NULL where it has none. Rules of several presets carry preset_id; then ``runs`` (container_id,
    preset_id; one preset a container) says which preset's rules a container takes."""
    if "preset_id" not in owner_rules.columns:
        return b.join(owner_rules.select("owner_key", F.col("rule").alias("_r")), "owner_key", "left")
    if runs is None:
        raise ValueError("owner rules of several presets need runs: container_id, preset_id")
    b = b.join(runs.select("container_id", F.col("preset_id").alias("_p")), "container_id", "left")
    r = owner_rules.select(F.col("preset_id").alias("_p"), "owner_key", F.col("rule").alias("_r"))
    return b.join(r, ["_p", "owner_key"], "left").drop("_p")


def _merge_aggs():
    """R2 as duplicate-insensitive aggregates over (asset, owner rule) rows."""
    r = F.col("_r")
    off = r.isNull() | (r["format"] == "keep")
    on = ~off
    return [
        F.array_sort(F.collect_set(F.when(off, F.col("owner_key")))).alias("blockers"),
        F.min(F.when(on, F.struct(format_rank(r["format"]).alias("rank"), r["format"].alias("format")))).alias("_f"),
        F.max(F.when(on, r["size"])).alias("_size"),
        F.min(F.when(on, r["sharpen_pct"])).alias("_pct"), F.max(on & r["sharpen_pct"].isNull()).alias("_pct_follow"),
        F.min(F.when(on, r["sharpen_mode"])).alias("_mode"), F.max(F.when(on, r["sharpen_mode"])).alias("_mode2"),
        F.max(on & r["sharpen_mode"].isNull()).alias("_mode_follow"),
        F.min(F.when(on, r["gray_a"])).alias("_gray"), F.max(F.when(on, r["gray_a"])).alias("_gray2"),
        F.max(on & r["gray_a"].isNull()).alias("_gray_follow"),
        F.max(F.when(on, r["up"])).alias("_up"),
    ]


def _finish_merge(df: DataFrame) -> DataFrame:
    def same(a, b, follow):
        return F.when((F.col(a) == F.col(b)) & ~F.col(follow), F.col(a))
    merged = rule(
        F.col("_f.format"), F.col("_size"), F.when(~F.col("_pct_follow"), F.col("_pct")),
        same("_mode", "_mode2", "_mode_follow"), same("_gray", "_gray2", "_gray_follow"),
        F.when(F.col("min_owner") == F.col("max_owner"), F.col("_up")))
    blocked = F.size("blockers") > 0
    df = df.withColumn("owner_rule", F.when(~blocked, merged))
    df = df.withColumn("owner_reason", F.when(blocked, F.concat(
        F.lit("left alone by "), F.array_join(F.transform("blockers", lambda k: k.cast("string")), ","))))
    return df.drop("_f", "_size", "_pct", "_pct_follow", "_mode", "_mode2", "_mode_follow",
                   "_gray", "_gray2", "_gray_follow", "_up")


def merge_owner_rules(owners: DataFrame, owner_rules: DataFrame, runs: DataFrame = None) -> DataFrame:
    """R2: one conservative rule per asset from the rules of all its owners.

    owners: container_id, asset_id, owner_key. owner_rule is NULL where an owner has no rule or keeps."""
    rows = with_owner_rule(owners, owner_rules, runs)
    agg = rows.groupBy(*ASSET_KEY).agg(
        F.min("owner_key").alias("min_owner"), F.max("owner_key").alias("max_owner"), *_merge_aggs())
    return _finish_merge(agg)


def with_props(assets: DataFrame, bindings: DataFrame) -> DataFrame:
    """Assets with their distinct property names (no binding -> empty array); a binding without one (NULL) adds none."""
    props = bindings.groupBy(*ASSET_KEY).agg(
        F.array_sort(F.collect_set(_first_list(bindings, F.col("property")))).alias("props"))
    return assets.join(props, ASSET_KEY, "left").withColumn(
        "props", F.coalesce("props", F.array().cast("array<string>")))


def asset_props(bindings: DataFrame) -> DataFrame:
    """A4: distinct property names per asset, long form; bindings without one (NULL) add none."""
    return bindings.select(*ASSET_KEY, "property").where(F.col("property").isNotNull()).distinct()


def orphans(assets: DataFrame, bindings: DataFrame) -> DataFrame:
    """Assets that no binding uses."""
    return assets.join(bindings.select(*ASSET_KEY), ASSET_KEY, "left_anti")


def asset_owners(bindings: DataFrame) -> DataFrame:
    """A5: owner set per asset. An owner set is bounded by the owner keys of one container."""
    out = bindings.groupBy(*ASSET_KEY).agg(F.array_sort(F.collect_set("owner_key")).alias("owners"))
    return out.withColumn("n_owners", F.size("owners")).withColumn("shared", F.col("n_owners") > 1)


def asset_signatures(bindings: DataFrame, grouped: bool = False) -> DataFrame:
    """Distinct signatures per asset, long form (container_id, asset_id, sig).

    grouped adds the group x slot form and, for body types, the group-less one."""
    if grouped:
        sigs = text.signatures_chara(*[F.col(c) for c in ("obj_type", "coord_idx", "slot", "material", "property")])
        rows = bindings.select(*ASSET_KEY, F.explode(sigs).alias("sig"))
    else:
        key = keys.owner_key(F.col("obj_type"), F.col("slot"))
        rows = bindings.select(*ASSET_KEY, text.signature(key, F.col("material"), F.col("property")).alias("sig"))
    return rows.distinct()


def first_wins(df: DataFrame, by, ord) -> DataFrame:
    """The row with the lowest ``ord`` per key, as a min aggregate (map-side combine, skew-safe).

    ``ord`` columns must identify a row within its key for the result to be deterministic."""
    by, ord = list(by), list(ord)
    rest = [c for c in df.columns if c not in by]
    ordered = ord + [c for c in rest if c not in ord]
    out = df.groupBy(*by).agg(F.min(F.struct(*ordered)).alias("_first"))
    return out.select(*by, *[F.col("_first." + c).alias(c) for c in ordered]).select(*df.columns)


def asset_shaders(bindings: DataFrame, shaders: DataFrame) -> DataFrame:
    """Distinct (asset, shader) rows; the first shader row of an (owner, material) counts."""
    by = ["container_id", "owner_key", "_mat"]
    sh = shaders.select("container_id", "ord", "shader",
                        keys.owner_key(F.col("obj_type"), F.col("slot")).alias("owner_key"),
                        text.norm_material(F.col("material")).alias("_mat"))
    first = sh.groupBy(*by).agg(F.min(F.struct("ord", "shader")).alias("_s")).select(*by, "_s.shader")
    first = first.where((F.col("shader").isNotNull()) & (F.col("shader") != ""))
    b = bindings.select(*ASSET_KEY, "owner_key", text.norm_material(F.col("material")).alias("_mat")).distinct()
    return b.join(first, by).select(*ASSET_KEY, "shader").distinct()


def all_non_alpha(assets: DataFrame, shader_rows: DataFrame) -> DataFrame:
    """True when at least one shader is known and none has 'alpha' in its name."""
    flags = shader_rows.groupBy(*ASSET_KEY).agg(
        (~F.max(F.lower("shader").contains("alpha"))).alias("non_alpha"))
    return assets.join(flags, ASSET_KEY, "left").withColumn("non_alpha", F.coalesce("non_alpha", F.lit(False)))


def sharing_pairs(bindings: DataFrame, assets: DataFrame) -> DataFrame:
    """Owner pairs of a container that use the same assets, with count and bytes.

    Assets with the same owner set collapse to one row first; pairs are then formed once per distinct
    owner set instead of once per asset."""
    sets = asset_owners(bindings).where("shared").select(*ASSET_KEY, "owners")
    sets = sets.join(assets.select(*ASSET_KEY, "n_bytes"), ASSET_KEY)
    sets = sets.groupBy("container_id", "owners").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b"))
    left = sets.select("container_id", "owners", "n", "b", F.explode("owners").alias("owner_a"))
    later = F.filter("owners", lambda o: o > F.col("owner_a"))
    pairs = left.select("container_id", "owner_a", "n", "b", F.explode(later).alias("owner_b"))
    return pairs.groupBy("container_id", "owner_a", "owner_b").agg(
        F.sum("n").alias("n_assets"), F.sum("b").alias("n_bytes"))
