"""Aggregations per class, owner, group, container and batch: A1-A3, A7-A16, J5."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlake import fixed as K
from assetlake.functions import classify as C
from assetlake.functions import keys, text
from assetlake.functions.sizes import pct
from assetlake.operators.assets import asset_profile
from assetlake.schemas import ASSET_KEY


def classed(assets: DataFrame, bindings: DataFrame) -> DataFrame:
    """Assets with their class; an unbound asset is 'other'."""
    p = asset_profile(bindings).select(*ASSET_KEY, "class")
    return assets.join(p, ASSET_KEY, "left").withColumn("class", F.coalesce("class", F.lit("other")))


def class_stats(classed_assets: DataFrame) -> DataFrame:
    """A1: per container and class."""
    return classed_assets.groupBy("container_id", "class").agg(
        F.count(F.lit(1)).alias("n_assets"), F.sum("n_bytes").alias("n_bytes"), F.max("dim").alias("max_dim"))


def corpus_totals(stats: DataFrame) -> DataFrame:
    """A2: class totals and the grand total ('total') from per-container partials."""
    out = stats.rollup("class").agg(
        F.sum("n_assets").alias("n_assets"), F.sum("n_bytes").alias("n_bytes"), F.max("max_dim").alias("max_dim"),
        F.grouping("class").alias("_g"))
    return out.select(F.when(F.col("_g") == 1, F.lit("total")).otherwise(F.col("class")).alias("class"),
                      "n_assets", "n_bytes", "max_dim")


def describe(containers: DataFrame, stats: DataFrame) -> DataFrame:
    """A3: text block per container, one line per class in report order (at most nine lines).

    containers: container_id, title. A container without assets says so."""
    line = F.format_string("    %-10s %4d  %10s  max %dpx", F.col("class"), F.col("n_assets"),
                           text.human_bytes(F.col("n_bytes")), F.col("max_dim"))
    body = stats.groupBy("container_id").agg(
        F.sum("n_assets").alias("_n"), F.sum("n_bytes").alias("_b"),
        F.array_sort(F.collect_list(F.struct(C.class_ord(F.col("class")).alias("o"), line.alias("l")))).alias("_l"))
    head = F.format_string("  %d assets / %s", F.col("_n"), text.human_bytes(F.col("_b")))
    block = F.concat_ws("\n", "title", head, F.array_join(F.transform("_l", lambda x: x["l"]), "\n"))
    none = F.concat_ws("\n", "title", F.lit("  no embedded assets"))
    return containers.join(body, "container_id", "left").select(
        "container_id", F.when(F.col("_n") > 0, block).otherwise(none).alias("description"))


def part_summary(bindings: DataFrame, assets: DataFrame, materials: bool = False) -> DataFrame:
    """Per container and owner; an asset counts once per owner, exclusive means one owner only.

    Owner sets are built once per asset (map-side combined, bounded by the owner keys of a container),
    meet the asset sizes on the same key and are spread again, so bindings are exchanged once. An owner whose bindings
    only name assets that are not there keeps its row with zeros. ``materials`` adds the sorted names that are not empty (bounded by one owner's binding list inside one container)."""
    sets = bindings.groupBy(*ASSET_KEY).agg(F.collect_set("owner_key").alias("_owners"))
    sized = sets.join(assets.select(*ASSET_KEY, "n_bytes", F.lit(1).alias("_there")), ASSET_KEY, "left")
    alone = (F.size("_owners") == 1) & F.col("_there").isNotNull()
    sized = sized.select("container_id", "n_bytes", "_there", alone.alias("exclusive"),
                         F.explode("_owners").alias("owner_key"))
    own = F.when(F.col("exclusive"), F.col("n_bytes")).otherwise(F.lit(0))
    out = sized.groupBy("container_id", "owner_key").agg(
        F.count("_there").alias("n_assets"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"),
        F.count_if("exclusive").alias("own_count"), F.coalesce(F.sum(own), F.lit(0)).alias("own_bytes"))
    if materials:
        mats = bindings.groupBy("container_id", "owner_key").agg(
            F.array_join(F.array_sort(F.collect_set(F.nullif("material", F.lit("")))), ",").alias("materials"))
        out = out.join(mats, ["container_id", "owner_key"], "left")
    return out


def complete_owners(parts: DataFrame, containers: DataFrame, grouped: bool = False) -> DataFrame:
    """Every clothes slot (or group header) of a container appears, empty ones with zeros.

    The domain (nine slots, eight headers) is exploded from a literal, so nothing is cross joined;
    the union is folded by a sum instead of an anti join."""
    if grouped:
        domain = [(g + 1) * K.GROUP_BASE for g in range(len(K.GROUP_NAMES) + 1)]
    else:
        domain = list(range(len(K.SLOT_TOKENS)))
    base = containers.select("container_id").distinct().select(
        "container_id", F.explode(F.array(*[F.lit(k) for k in domain])).alias("owner_key"))
    nums = ["n_assets", "n_bytes", "own_count", "own_bytes"]
    empty = base.select("container_id", "owner_key", *[F.lit(0).cast("long").alias(c) for c in nums])
    both = parts.select("container_id", "owner_key", *nums).unionByName(empty)
    return both.groupBy("container_id", "owner_key").agg(*[F.sum(c).alias(c) for c in nums])


def parts_in_use(parts: DataFrame) -> DataFrame:
    """A15."""
    return parts.groupBy("container_id").agg(F.count_if(F.col("n_assets") > 0).alias("parts_in_use"))


def group_summary(parts: DataFrame) -> DataFrame:
    """One row per group (level 'group') and per part (level 'part') in one pass.

    parts carry group x slot keys; keys without a group report group -1."""
    used = parts.where("n_assets > 0").withColumn(
        "group_no", F.when(keys.is_group_key(F.col("owner_key")), keys.key_group(F.col("owner_key")))
        .otherwise(F.lit(-1)))
    c, g, o = F.col("container_id"), F.col("group_no"), F.col("owner_key")
    out = used.groupingSets([[c, g], [c, g, o]], c, g, o).agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("n_assets").alias("n_assets"), F.sum("n_bytes").alias("n_bytes"),
        F.grouping(o).alias("_g"))
    return out.select("container_id", "group_no",
                      F.when(F.col("_g") == 1, F.lit("group")).otherwise(F.lit("part")).alias("level"),
                      F.when(F.col("_g") == 0, o).alias("owner_key"), "n_parts", "n_assets", "n_bytes")


def owner_count(bindings: DataFrame, by=(), approx: bool = False) -> DataFrame:
    """A10."""
    f = F.approx_count_distinct if approx else F.count_distinct
    return bindings.groupBy(*by).agg(f(F.col("owner_key")).alias("n_owner_keys"))


def fingerprint(bindings: DataFrame, grouped: bool = False) -> DataFrame:
    """Distinct (container_id, sig). Grouped containers use body signatures (without group) and
    fall back to all their signatures when they have none."""
    mat, prop = F.col("material"), F.col("property")
    plain = text.signature(keys.owner_key(F.col("obj_type"), F.col("slot")), mat, prop)
    if not grouped:
        return bindings.select("container_id", plain.alias("sig")).distinct()
    sigs = text.signatures_chara(F.col("obj_type"), F.col("coord_idx"), F.col("slot"), mat, prop)
    body = bindings.where("obj_type >= 3")
    no_body = bindings.groupBy("container_id").agg(F.max("obj_type").alias("_t")).where("_t < 3").select("container_id")
    rest = bindings.join(no_body, "container_id", "left_semi").select("container_id", F.explode(sigs).alias("sig"))
    return body.select("container_id", plain.alias("sig")).unionByName(rest).distinct()


def container_rollup(outcomes: DataFrame) -> DataFrame:
    """A11 (+A13): counters per container. 'PNG*', 'JPEG*' and 'orig' enter no format counter."""
    fmt = F.col("fmt")

    def flag(name):
        return F.count_if(F.col(name)) if name in outcomes.columns else F.lit(0).cast("long")

    def total(name):
        return F.coalesce(F.sum(name), F.lit(0)).cast("long") if name in outcomes.columns else F.lit(0).cast("long")
    out = outcomes.groupBy("container_id").agg(
        F.count(F.lit(1)).alias("n_assets"),
        F.count_if(fmt == "JPEG").alias("n_jpeg"), F.count_if(fmt == "PNG").alias("n_png"),
        F.count_if(fmt == "HDR").alias("n_hdr"), F.count_if(fmt == "keep").alias("n_keep"),
        F.count_if(fmt == "orig").alias("n_same"),
        F.count_if(fmt.isin("PNG*", "JPEG*")).alias("n_keep_opt"),
        F.sum(F.when(fmt.isin("PNG*", "JPEG*"), F.col("raw_bytes") - F.col("out_bytes")).otherwise(F.lit(0)))
        .cast("long").alias("keep_opt_saved"),
        flag("packed").alias("n_packed"), total("packed_saved").alias("packed_saved"),
        flag("protected").alias("n_protected"), flag("upscaled").alias("n_upscaled"),
        flag("blocked_data").alias("n_blocked_data"), flag("blocked_cap").alias("n_blocked_cap"),
        total("up_pixels_before").alias("up_pixels_before"), total("up_pixels_after").alias("up_pixels_after"),
        F.sum("raw_bytes").cast("long").alias("payload_before"), F.sum("out_bytes").cast("long").alias("payload_after"))
    return out.withColumn("payload_pct", pct(F.col("payload_after"), F.col("payload_before")))


def outcome_lists(outcomes: DataFrame, lists) -> DataFrame:
    """A11 id lists, long form: one row per (container, list name, asset). lists: {name: Column}."""
    names = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in lists.items()]))
    return outcomes.select("container_id", "asset_id", "ord", F.explode(names).alias("list_name"))


def batch_summary(co: DataFrame) -> DataFrame:
    """One row of totals. rc 3 and 6 are skips; copies enter neither counts nor bytes; a failed
    verification counts as failure but still adds its bytes.

    co: rc, copied, verified, bytes_before, bytes_after (NULL rc means the run itself failed)."""
    rc, copied = F.col("rc"), F.col("copied")
    written = (rc == 0) & ~copied
    skipped = rc.isin(3, 6)
    failed = rc.isNull() | ((rc != 0) & ~skipped) | (written & ~F.col("verified"))
    out = co.agg(
        F.count_if(written & F.col("verified")).alias("n_ok"), F.count_if(skipped).alias("n_skipped"),
        F.count_if(failed).alias("n_failed"), F.count_if((rc == 0) & copied).alias("n_copied"),
        F.coalesce(F.sum(F.when(written, F.col("bytes_before"))), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum(F.when(written, F.col("bytes_after"))), F.lit(0)).alias("bytes_after"))
    return out.withColumn("pct", pct(F.col("bytes_after"), F.col("bytes_before")))


def batch_lists(co: DataFrame) -> DataFrame:
    """A12 lists, long form: container_id, list ('failed', 'skipped'), reason."""
    rc, copied = F.col("rc"), F.col("copied")
    verify = (rc == 0) & ~copied & ~F.col("verified")
    kind = (F.when(rc.isNull() | verify, F.lit("failed")).when(rc.isin(3, 6), F.lit("skipped"))
            .when(rc != 0, F.lit("failed")))
    given = F.when(F.col("reason") != "", F.col("reason"))
    why = F.when(verify, F.lit("output failed verification")).otherwise(F.coalesce(given, text.rc_text(rc)))
    return co.select("container_id", kind.alias("list"), why.alias("reason")).where(F.col("list").isNotNull())


def group_probe(parts: DataFrame, n: int = 6) -> DataFrame:
    """Highest group over the first ``n`` grouped containers, and how many owners lie beyond
    the last maskable group. Taking the first ``n`` is the feature, not a shortcut."""
    grouped = parts.where(keys.is_group_key(F.col("owner_key")))
    first = grouped.select("container_id").distinct().orderBy("container_id").limit(n)
    g = keys.key_group(F.col("owner_key"))
    out = grouped.join(first, "container_id", "left_semi").agg(
        F.max(g).alias("_m"), F.count_if(g > K.MAX_MASK_GROUP).alias("owners_beyond"))
    return out.select(F.greatest(F.coalesce("_m", F.lit(0)), F.lit(len(K.GROUP_NAMES))).alias("max_group"),
                      "owners_beyond")


def byte_share(df: DataFrame, item: str, scope=()) -> DataFrame:
    """Bytes per item and their share of the scope total, in percent.

    The total runs over aggregated rows only: one row per item of a scope (nine for classes)."""
    per = df.groupBy(*scope, item).agg(F.sum("n_bytes").alias("n_bytes"))
    total = F.sum("n_bytes").over(Window.partitionBy(*scope)) if scope else per.agg(F.sum("n_bytes")).scalar()
    return per.withColumn("share_pct", F.lit(100.0) * F.col("n_bytes") / total)
