"""Q1-Q6: the jobs a user runs, as compositions of the operators."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.functions import keys
from assetlake.operators import assets as A
from assetlake.operators import resolve as R
from assetlake.operators import summaries as S
from assetlake.operators.ordering import order_parts
from assetlake.operators.outcomes import choose_candidate, keep_or


def scan_report(inv: dict) -> dict:
    """Q1: per-container class statistics, corpus totals and description blocks."""
    stats = S.class_stats(S.classed(inv["assets"], inv["bindings"]))
    out = {"stats": stats, "totals": S.corpus_totals(stats)}
    if "containers" in inv:
        out["descriptions"] = S.describe(inv["containers"].select(
            "container_id", F.col("container_id").cast("string").alias("title")), stats)
    return out


def parts_report(inv: dict, grouped: bool = False) -> DataFrame:
    """Q2: every owner of every container with its assets, bytes, exclusive share and the container's
    orphan count; unused slots appear with zeros, after the used ones."""
    parts = S.part_summary(inv["bindings"], inv["assets"])
    full = S.complete_owners(parts, inv["assets"].select("container_id"), grouped)
    lost = A.orphans(inv["assets"], inv["bindings"]).groupBy("container_id").agg(
        F.count(F.lit(1)).alias("n_orphans"), F.sum("n_bytes").alias("orphan_bytes"))
    out = full.join(lost, "container_id", "left")
    for c in ("n_orphans", "orphan_bytes"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0).cast("long")))
    return order_parts(out.withColumn("owner_name", keys.owner_name(F.col("owner_key"))))


def group_report(inv: dict) -> DataFrame:
    """Q3: group and part rows (A9) plus one 'orphans' row per container that has any."""
    rows = S.group_summary(S.part_summary(inv["bindings"], inv["assets"]))
    lost = A.orphans(inv["assets"], inv["bindings"]).groupBy("container_id").agg(
        F.count(F.lit(1)).alias("n_assets"), F.sum("n_bytes").alias("n_bytes"))
    none = F.lit(None).cast("int")
    lost = lost.select("container_id", none.alias("group_no"), F.lit("orphans").alias("level"),
                       none.alias("owner_key"), F.lit(0).cast("long").alias("n_parts"), "n_assets", "n_bytes")
    return rows.unionByName(lost)


def plan_corpus(inv: dict, plan: DataFrame = None, owner_rules: DataFrame = None, own_max: int = 4096,
                up: int = 0, protect: bool = True, **kw) -> DataFrame:
    """Q4: rule, reason, format, cap and target size for every asset of the corpus.

    inv["assets"] carries width, height, flat_alpha and circle_only (defaults when absent)."""
    df = R.resolve_rules(_with_alpha(inv["assets"]), inv["bindings"], plan=plan, owner_rules=owner_rules, **kw)
    return _sized_plan(df, own_max, up, protect)


def _with_alpha(assets: DataFrame) -> DataFrame:
    for c in ("flat_alpha", "circle_only"):
        if c not in assets.columns:
            assets = assets.withColumn(c, F.lit(c == "flat_alpha"))
    return assets


def _sized_plan(df: DataFrame, own_max: int, up: int, protect: bool) -> DataFrame:
    df = R.decide_format(df)
    df = R.protect_exclusive(df, own_max) if protect else df.withColumn("protected", F.lit(False))
    return R.plan_sizes(df, up)


def summarise(candidates: DataFrame, containers: DataFrame) -> dict:
    """Q5: candidate sizes -> chosen outcomes -> container rollup -> batch summary.

    containers: container_id, rc, copied, verified, reason, bytes_before. A written container shrinks by
    what its payload lost."""
    outcomes = choose_candidate(candidates)
    if "keep" in candidates.columns:
        outcomes = keep_or(outcomes)
    rollup = S.container_rollup(outcomes)
    gain = rollup.select("container_id", (F.col("payload_before") - F.col("payload_after")).alias("_gain"))
    co = containers.join(gain, "container_id", "left").withColumn(
        "bytes_after", F.col("bytes_before") - F.coalesce("_gain", F.lit(0))).drop("_gain")
    return {"outcomes": outcomes, "containers": rollup, "batch": S.batch_summary(co), "lists": S.batch_lists(co)}


PROFILE = ["class", "risky", "exclusive", "width", "height", "flat_alpha", "circle_only", "n_bytes"]


def asset_profiles(inv: dict) -> DataFrame:
    """Assets that no plan can tell apart, as one row with their number (weight): PROFILE and weight."""
    df = R.resolve_rules(_with_alpha(inv["assets"]), inv["bindings"])
    return df.groupBy(*PROFILE).agg(F.count(F.lit(1)).alias("weight"))


def compare_plans(inv: dict, plans: DataFrame, plan_ids, bytes_per_pixel: float = 1.0, own_max: int = 4096, up: int = 0,
                  protect: bool = True) -> DataFrame:
    """Q6: the same corpus under several plans, side by side per class: assets a plan changes and bytes
    after scaling every changed asset by its share of kept pixels.

    Assets collapse to distinct profiles with weights before plans meet them through the class key, so the sweep grows with
    the profiles, not with the assets; the pivot runs on (class, plan) rows."""
    df = R.rules_by_class(asset_profiles(inv), plans).withColumn("rule", F.col("class_rule"))
    df = _sized_plan(df.withColumn("keep", F.coalesce(F.col("rule.format") == "keep", F.lit(False))), own_max, up, protect)
    share = (F.col("target_width") * F.col("target_height")).cast("double") / F.greatest(
        F.col("width") * F.col("height"), F.lit(1))
    after = F.when(F.col("keep"), F.col("n_bytes")).otherwise(
        F.least(F.floor(F.col("n_bytes") * share * F.lit(float(bytes_per_pixel))), F.col("n_bytes")))
    per = df.groupBy("class", "plan_id").agg(
        F.sum(F.when(~F.col("keep"), F.col("weight")).otherwise(0)).alias("changed"), F.sum(after * F.col("weight")).cast("long").alias("bytes_after"))
    return per.groupBy("class").pivot("plan_id", list(plan_ids)).agg(
        F.first("changed").alias("changed"), F.first("bytes_after").alias("bytes_after"))
