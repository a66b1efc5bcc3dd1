"""Rule resolution: J6, J14, R1, R5-R7, R9, R11-R14, R17-R20, P16/P15 in context."""
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake import fixed as K
from assetlake.functions import keys
from assetlake.functions.rules import no_rule, rule, rule_text
from assetlake.functions.sizes import shrink_scale, target_size, upscale_plan
from assetlake.operators.assets import asset_profile
from assetlake.schemas import ASSET_KEY, RULE


def literal_rows(spark: SparkSession, rows, fields: str) -> DataFrame:
    """A small table from literal dicts. Unlike a table made of Python rows, its size is known to the
    optimizer, so joins with it broadcast without a hint and nothing large is shuffled for it."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def builtin_plans(spark: SparkSession) -> DataFrame:
    """plan_id, class, ord, rule for every built-in plan (nine rows each)."""
    rows = []
    for plan_id, (main, rest) in K.BUILTIN_PLANS.items():
        for i, cls in enumerate(K.CLASS_ORDER):
            fmt, size = main if cls == "maintex" else rest
            rows.append({"plan_id": plan_id, "class": cls, "ord": i, "rule": {"format": fmt, "size": size}})
    return literal_rows(spark, rows, f"plan_id:string,class:string,ord:int,rule:{RULE}")


def plan_rule(plan: dict, cls: Column) -> Column:
    """J6 for a plan known on the driver ({class: (format, size)}, at most nine classes)."""
    out = no_rule()
    for c, (fmt, size) in plan.items():
        out = F.when(cls == c, rule(fmt, size)).otherwise(out)
    return out


def rules_by_class(assets: DataFrame, plan: DataFrame) -> DataFrame:
    """The rule of the asset's class; a class the plan does not name gives NULL.

    A plan has a row for each class, those that a caller defines included; a class named twice is an error. Plans are
    small, so Spark broadcasts them by their size. With several plans (plan_id) every asset meets every plan through the
    class key."""
    if "plan_id" in plan.columns:
        return assets.join(plan.select("plan_id", "class", F.col("rule").alias("class_rule")), "class", "left")
    twice = F.raise_error(F.concat(F.lit("the plan names a class twice: "), F.col("class")))
    known = plan.groupBy("class").agg(F.max("rule").alias("class_rule"), F.count(F.lit(1)).alias("_n"))
    known = known.select("class", F.when(F.col("_n") > 1, twice).otherwise(F.col("class_rule")).alias("class_rule"))
    return assets.join(known, "class", "left")


def is_noop(plan: DataFrame, by=("plan_id",)) -> DataFrame:
    """R12."""
    return plan.groupBy(*by).agg(F.every(F.col("rule.format") == "keep").alias("noop"))


def lint_plan(plan: DataFrame, sharpen_pct: Column, by=("plan_id",)) -> DataFrame:
    """Sharpening is asked for although no class both changes format and has a size cap."""
    caps = plan.groupBy(*by).agg(
        F.some((F.col("rule.format") != "keep") & (F.col("rule.size") > 0)).alias("_cap"),
        F.max(sharpen_pct).alias("_pct"))
    return caps.select(*by, ((F.col("_pct") > 0) & ~F.col("_cap")).alias("sharpen_inert"))


def resolve_rules(assets: DataFrame, bindings: DataFrame, plan: DataFrame = None, only=None, mask: int = 0,
                  owner_rules: DataFrame = None, asset_hits: DataFrame = None, routes: DataFrame = None,
                  extra=(), runs: DataFrame = None) -> DataFrame:
    """One rule per asset; later layers win.

    class plan -> allow-list (only without a class rule) -> group mask forces keep -> uniform rule of a
    forced container -> merged owner rule (not in uniform mode) -> preset asset rule (not when forced).

    bindings carry owner_key; owner_rules: owner_key, rule, and preset_id with ``runs`` (container_id, preset_id) where
    containers take the rules of different presets; asset_hits: output of merge_preset_hits;
    routes: container_id, action, uniform. Bindings are exchanged once on the asset key, which is also
    the join key of every later layer. Adds class, exclusive, min_owner, rule, keep, source, reason."""
    p = asset_profile(bindings, owner_rules, mask, only, runs=runs).withColumn("_bound", F.lit(True))
    df = assets.join(p, ASSET_KEY, "left").withColumn("class", F.coalesce("class", F.lit("other")))
    df = df.withColumn("risky", F.coalesce("risky", F.lit(False)))
    df = df.withColumn("exclusive", F.coalesce("exclusive", F.lit(False)))
    df = rules_by_class(df, plan) if plan is not None else df.withColumn("class_rule", no_rule())
    if asset_hits is not None:
        df = df.join(asset_hits.select(*ASSET_KEY, "asset_rule"), ASSET_KEY, "left")
    if routes is not None:
        df = df.join(routes.select("container_id", "action", "uniform"), "container_id", "left")

    by_class = F.col("class_rule")
    r, source = by_class, F.when(by_class.isNotNull(), F.lit("class")).otherwise(F.lit("none"))
    keep = F.coalesce(by_class["format"] == "keep", F.lit(False))
    reason = F.when(keep, F.lit("class plan keeps it"))
    if only:
        hit = F.coalesce(F.col("only_hit"), F.lit(False))
        keep = F.when(by_class.isNull(), ~hit).otherwise(keep)
        reason = F.when(by_class.isNull() & ~hit, F.lit("not in the allow-list")).otherwise(reason)
        source = F.when(by_class.isNull(), F.lit("only")).otherwise(source)
    if mask:
        off = F.coalesce(F.col("off_mask"), F.lit(False))
        keep = off | keep
        source = F.when(off, F.lit("mask")).otherwise(source)
        reason = F.when(off, F.lit("an owner group is not selected")).otherwise(reason)
    uniform = F.lit(False)
    if routes is not None:
        uniform = F.coalesce(F.col("action") == "uniform", F.lit(False))
        u = rule(F.col("uniform.format"), F.col("uniform.size"))
        r = F.when(uniform, u).otherwise(r)
        keep = F.when(uniform, F.col("uniform.format") == "keep").otherwise(keep)
        source = F.when(uniform, F.lit("uniform")).otherwise(source)
        reason = F.when(uniform, F.lit("container does not match the preset")).otherwise(reason)
    if owner_rules is not None:
        merged = F.col("owner_rule")
        r = F.when(~uniform & merged.isNotNull(), merged).otherwise(r)
        keep = F.when(uniform, keep).otherwise(merged.isNull())
        why = (F.when(F.col("_bound").isNull(), F.lit("no owner"))
               .when(merged.isNull(), F.col("owner_reason"))
               .when(~F.col("exclusive"), F.lit("shared by its owners")))
        source = F.when(uniform, source).otherwise(F.lit("owner"))
        reason = F.when(uniform, reason).otherwise(why)
    if asset_hits is not None:
        a = F.col("asset_rule")
        hit = a.isNotNull() & ~uniform
        r = F.when(hit, a).otherwise(r)
        keep = F.when(hit, a["format"] == "keep").otherwise(keep)
        source = F.when(hit, F.lit("preset")).otherwise(source)
        reason = F.when(hit, F.lit("single asset rule")).otherwise(reason)
    df = df.withColumns({"rule": r, "keep": keep, "source": source, "reason": reason})
    return df.drop("_bound", "class_rank", "class_rule", "asset_rule", "owner_rule", "owner_reason", "blockers",
                   "only_hit", "off_mask", "action", "uniform", *extra)


def decide_format(df: DataFrame, mode: str = "auto", max_size: int = 1024, mask_size: int = 1024,
                  force_classes=(), force_gate: int = 0, non_alpha: bool = False,
                  matcap_circle: bool = True) -> DataFrame:
    """Adds use_jpeg, auto_mode, cap, forced, alpha_lost.

    needs rule, keep, class, risky, flat_alpha, circle_only, width, height (and non_alpha for the shader
    rule). Without a rule the mode decides (R20)."""
    flat, circle = F.col("flat_alpha"), F.col("circle_only")
    ok = flat | (F.lit(matcap_circle) & (F.col("class") == "matcap") & circle)
    safe = ok & ~F.col("risky")
    fmt = F.when(F.coalesce(F.col("rule.format"), F.lit("")) == "", F.lit("auto")).otherwise(F.col("rule.format"))
    has = F.col("rule").isNotNull()
    by_rule = F.when(fmt == "jpeg", F.lit(True)).when(fmt == "png", F.lit(False)).otherwise(safe)
    by_mode = F.lit(True) if mode == "jpg" else (safe if mode == "auto" else F.lit(False))
    use = F.when(has, by_rule).otherwise(by_mode)
    auto = F.when(has, fmt == "auto").otherwise(F.lit(mode == "auto"))
    longest = F.greatest("width", "height")
    cap = (F.when(has, F.when(F.col("rule.size") > 0, F.col("rule.size")).otherwise(longest))
           .otherwise(F.when(by_mode, F.lit(max_size)).otherwise(F.lit(mask_size))))
    df = df.withColumns({"use_jpeg": use, "auto_mode": auto, "cap": cap.cast("int")})
    push = F.lit(False)
    if force_classes:
        gate = {0: F.lit(True), 1: flat, 2: flat | circle}[force_gate]
        push = push | (F.col("class").isin(*force_classes) & gate)
    if non_alpha:
        push = push | (flat & F.col("non_alpha"))
    forced = push & ~F.col("keep") & ~F.col("use_jpeg")
    df = df.withColumn("forced", F.coalesce(forced, F.lit(False)))
    return (df.withColumn("alpha_lost", F.col("forced") & ~flat)
            .withColumn("cap", F.when(F.col("forced") & (F.col("cap") <= 0), F.lit(max_size)).otherwise(F.col("cap")))
            .withColumn("use_jpeg", F.col("use_jpeg") | F.col("forced"))
            .withColumn("auto_mode", F.col("auto_mode") & ~F.col("forced")))


def protect_exclusive(df: DataFrame, own_max: int = K.OWN_MAX) -> DataFrame:
    """An asset of one owner gets a raised cap (own_max 0: its own size), never a lower one."""
    wide = F.lit(own_max) if own_max > 0 else F.greatest("width", "height")
    lift = F.col("exclusive") & ~F.col("keep") & (wide > F.col("cap"))
    return df.withColumn("protected", lift).withColumn(
        "cap", F.when(lift, wide).otherwise(F.col("cap")).cast("int"))


def plan_sizes(df: DataFrame, up: int = 0, ceiling: int = K.UP_CEILING) -> DataFrame:
    """P16 then P15: up_factor, up_reason, target_width, target_height, scale."""
    want = F.coalesce(F.col("rule.up"), F.lit(up))
    df = df.withColumn("_up", upscale_plan(F.col("class"), F.col("width"), F.col("height"), F.col("cap"), want, ceiling))
    fit = target_size(F.col("width"), F.col("height"), F.col("cap"))
    grown = F.col("_up.factor") > 1
    return df.withColumns({
        "up_factor": F.col("_up.factor"), "up_reason": F.col("_up.reason"),
        "scale": F.when(grown, F.col("_up.factor").cast("double"))
        .otherwise(shrink_scale(F.col("width"), F.col("height"), F.col("cap"))),
        "target_width": F.when(grown, F.col("width") * F.col("_up.factor")).otherwise(fit["width"]),
        "target_height": F.when(grown, F.col("height") * F.col("_up.factor")).otherwise(fit["height"]),
    }).drop("_up")


def hdr_plan(df: DataFrame, mode: str = "auto", max_size: int = 1024, mask_size: int = 1024) -> DataFrame:
    """Linear images. The cap is the rule's size (0 is unlimited), never larger than the source; a
    result that is not smaller than the original keeps it. needs rule, width, height, raw_bytes, new_bytes."""
    bare = mask_size if mode == "png" else max_size
    cap = F.when(F.col("rule").isNotNull(), F.col("rule.size")).otherwise(F.lit(bare))
    over = (cap > 0) & (F.greatest("width", "height") > cap)
    used = over & (F.col("new_bytes") < F.col("raw_bytes"))
    t = target_size(F.col("width"), F.col("height"), cap)
    return df.withColumns({
        "fmt": F.when(used, F.lit("HDR")).otherwise(F.lit("orig")),
        "out_bytes": F.when(used, F.col("new_bytes")).otherwise(F.col("raw_bytes")),
        "out_width": F.when(used, t["width"]).otherwise(F.col("width")),
        "out_height": F.when(used, t["height"]).otherwise(F.col("height"))})


def apply_uniform(rules: DataFrame, scope: str = "all", group: int = None, cls: str = None,
                  values: dict = None, up: int = None) -> DataFrame:
    """Bulk edit. scope: all, group, enabled or class. rules: owner_key or class, enabled, rule.

    ``up`` is only written to rows that change the format."""
    hit = F.lit(True)
    if scope == "group":
        hit = keys.key_group(F.col("owner_key")) == group
    elif scope == "enabled":
        hit = F.col("enabled")
    elif scope == "class":
        hit = F.col("class") == cls
    v = values or {}
    old = F.col("rule")
    new = {f: (F.when(hit, F.lit(v[f]).cast(t)).otherwise(old[f]) if f in v else old[f])
           for f, t in (("format", "string"), ("size", "int"), ("sharpen_pct", "int"),
                        ("sharpen_mode", "string"), ("gray_a", "int"), ("up", "int"))}
    if up is not None:
        new["up"] = F.when(hit & (new["format"] != "keep"), F.lit(up)).otherwise(new["up"])
    return rules.withColumn("rule", rule(new["format"], new["size"], new["sharpen_pct"], new["sharpen_mode"],
                                         new["gray_a"], new["up"])).withColumn("touched", hit)


def clear_overrides(overrides: DataFrame, bindings: DataFrame, scope: Column) -> DataFrame:
    """Drop single-asset overrides of assets that an owner in ``scope`` (on owner_key) uses."""
    inside = bindings.where(scope).select(*ASSET_KEY)
    return overrides.join(inside, ASSET_KEY, "left_anti")


def final_handling(df: DataFrame) -> DataFrame:
    """One text per asset: what happens and why. Input: output of resolve_rules."""
    shared = F.when((F.col("source") == "owner") & ~F.col("exclusive"), F.lit(" (by its shared rule)")).otherwise("")
    text = (F.when(F.col("source") == "preset", F.concat(F.lit("single asset: "), rule_text(F.col("rule"))))
            .when(F.col("keep"), F.concat_ws(" -- ", F.lit("unchanged"), F.col("reason")))
            .when(F.col("rule").isNull(), F.lit("by mode"))
            .otherwise(F.concat(rule_text(F.col("rule")), shared)))
    return df.withColumn("handling", text)


def expand_all_owners(parts: DataFrame, fmt: str = "auto", size: int = 1024) -> DataFrame:
    """The same rule for every owner of the container that has assets, accessories included."""
    return parts.where("n_assets > 0").select("container_id", "owner_key", rule(fmt, size).alias("rule"))


def resolve_by_mode(df: DataFrame, mode: str, max_size: int, mask_size: int) -> DataFrame:
    """No plan at all. maintex is auto plus an allow-list of that one word (needs only_hit)."""
    df = df.withColumn("rule", no_rule())
    if mode == "maintex":
        df = df.withColumn("keep", ~F.coalesce(F.col("only_hit"), F.lit(False)))
        mode = "auto"
    else:
        df = df.withColumn("keep", F.lit(False))
    return decide_format(df, mode, max_size, mask_size)


def merge_settings(*layers, fields) -> dict:
    """Presence semantics over nullable columns, first layer wins: an absent field never acts as
    false or 0. layers are column prefixes (explicit, file, default); returns {field: Column}."""
    return {f: F.coalesce(*[F.col(p + f) for p in layers]) for f in fields}
