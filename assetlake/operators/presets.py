"""Preset matching and routing: J8-J11, R3, R4, R10, R15, R21, X1-X3."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlake.functions.rules import format_rank, no_rule, rule
from assetlake.operators import rule_units
from assetlake.operators.assets import asset_signatures
from assetlake.operators.skew import salted_join
from assetlake.operators.summaries import fingerprint
from assetlake.schemas import ASSET_KEY
from assetlake.session import cut_lineage


def all_sigs(presets: DataFrame, stored: DataFrame, asset_rules: DataFrame) -> DataFrame:
    """Distinct (preset_id, sig): the stored fingerprint if there is one, else the signatures of the
    preset's asset rules. presets: preset_id; stored: preset_id, sig; asset_rules: preset_id, sigs."""
    bare = presets.select("preset_id").join(stored.select("preset_id"), "preset_id", "left_anti")
    own = asset_rules.join(bare, "preset_id", "left_semi").select("preset_id", F.explode("sigs").alias("sig"))
    return stored.select("preset_id", "sig").unionByName(own).distinct()


def sig_overlap(a, b):
    """X2 for two array columns."""
    return F.size(F.array_intersect(a, b))


def empty_presets(presets: DataFrame, preset_sigs: DataFrame, containers: DataFrame, by=("rel_dir", "kind")) -> DataFrame:
    """A preset without signatures scores 1 on every container of its place (``by``). Such a preset fits every
    container there, so their number is the number of fits, not of pairs looked at."""
    bare = presets.join(preset_sigs.select("preset_id").distinct(), "preset_id", "left_anti").select("preset_id", *by)
    fits = containers.select("container_id", *by).join(bare, list(by))
    zero = F.lit(0).cast("long")
    return fits.select("preset_id", "container_id", zero.alias("n_hits"), zero.alias("n_sigs"), F.lit(1.0).alias("score"))


def match_score(preset_sigs: DataFrame, container_sigs: DataFrame, presets: DataFrame = None, containers: DataFrame = None,
                by=("rel_dir", "kind")) -> DataFrame:
    """Share of a preset's signatures found on a container, for every pair with a common one.

    Pairs that share nothing score 0 and are left out (their number is presets x containers). With ``presets`` and
    ``containers``, presets without signatures score 1 on the containers of their place. Signatures that the same
    presets hold are one class: containers count them by class, so a signature of every preset is no row for each of them, and
    only the counts meet the presets. A signature that many containers carry is dealt over salts (``skew``)."""
    p = cut_lineage(preset_sigs.select("preset_id", "sig").distinct())
    n = p.groupBy("preset_id").agg(F.count(F.lit(1)).alias("n_sigs"))
    # fingerprint of the presets that hold a signature, order-free, 2 x 64 bits plus their number
    same = ["_k", "_h1", "_h2"]
    holders = p.groupBy("sig").agg(F.count(F.lit(1)).alias("_k"), F.bit_xor(F.xxhash64("preset_id")).alias("_h1"),
                                   F.bit_xor(F.xxhash64(F.lit(7), "preset_id")).alias("_h2"))
    classes = cut_lineage(holders.join(holders.groupBy(*same).agg(F.min("sig").alias("_class")), same).select("sig", "_class"))
    members = p.join(classes.where("sig = _class"), "sig").select("preset_id", "_class")
    met = salted_join(container_sigs.select("container_id", "sig"), classes, ["sig"], ["container_id"]).select("container_id", "sig", "_class").distinct()
    per = met.groupBy("container_id", "_class").agg(F.count(F.lit(1)).alias("_n"))
    hits = per.join(members, "_class").groupBy("preset_id", "container_id").agg(F.sum("_n").alias("n_hits"))
    out = hits.join(n, "preset_id").select(
        "preset_id", "container_id", "n_hits", "n_sigs", (F.col("n_hits") / F.col("n_sigs")).alias("score"))
    return out if presets is None else out.unionByName(empty_presets(presets, p, containers, by))


def score_against(containers: DataFrame, container_sigs: DataFrame, preset_sigs: DataFrame) -> DataFrame:
    """J10 for one preset: every container gets a score, 0 without overlap and 1 for an empty preset.

    The preset's size enters as a scalar subquery, not as a join."""
    p = preset_sigs.select("sig").distinct()
    n = p.agg(F.count(F.lit(1))).scalar()
    # meet the preset first, then drop repeats: what is distinct by container and signature lies together already
    hits = (container_sigs.select("container_id", "sig").join(p, "sig").distinct()
            .groupBy("container_id").agg(F.count(F.lit(1)).alias("n_hits")))
    out = containers.join(hits, "container_id", "left").withColumn("n_sigs", n)
    score = F.when(F.col("n_sigs") == 0, F.lit(1.0)).otherwise(
        F.coalesce(F.col("n_hits"), F.lit(0)) / F.greatest(F.col("n_sigs"), F.lit(1)))
    return out.withColumn("score", score).drop("n_hits", "n_sigs")


def similar_containers(presets: DataFrame, preset_sigs: DataFrame, containers: DataFrame, container_sigs: DataFrame,
                       min_match: float = 0.5) -> DataFrame:
    """Containers of a preset's directory and kind that hold at least ``min_match`` of its signatures.

    A preset without signatures fits every container of its place. presets: preset_id, rel_dir, kind; containers: container_id, rel_dir, kind; both sig tables long form.

    Exact prefix filter: a container that holds >= need of a preset's n signatures holds at least one of
    any n - need + 1 of them, so only the preset's rarest signatures generate candidates. Rarity is taken
    in power-of-two bands (at most 64 rows per preset in the running sum) and a whole band is kept, so
    the probe set is a superset of the minimum. Copies (same signature set, directory and kind) collapse
    to one representative before matching and fan out at the end, once per preset.

    The signatures, those of the representatives and the banded preset signatures are written once each, as several steps
    read them. A signature that most containers of a place carry is dealt over salts where probes meet containers."""
    place = ["rel_dir", "kind"]
    sigs = cut_lineage(container_sigs.select("container_id", "sig").distinct())
    # fingerprint of a whole set: order-free, 2 x 64 bits plus the size
    mark = sigs.groupBy("container_id").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("sig")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(7), "sig")).alias("h2"))
    named = containers.select("container_id", *place).join(mark, "container_id")
    same = place + ["n", "h1", "h2"]
    reps = named.groupBy(*same).agg(F.min("container_id").alias("rep"))
    members = cut_lineage(named.join(reps, same).select("container_id", "rep", *place))
    reps = members.where(F.col("container_id") == F.col("rep")).select("rep", *place)
    rep_sigs = cut_lineage(sigs.withColumnRenamed("container_id", "rep").join(reps, "rep"))
    freq = rep_sigs.groupBy(*place, "sig").agg(F.count(F.lit(1)).alias("_n"))
    own = cut_lineage(preset_sigs.select("preset_id", "sig").distinct())
    total = own.groupBy("preset_id").agg(F.count(F.lit(1)).alias("n_sigs"))
    own = own.join(presets.select("preset_id", *place), "preset_id").join(total, "preset_id")
    # a signature no container of the place has sits in the lowest band and matches nothing
    banded = cut_lineage(own.join(freq, place + ["sig"], "left").withColumn(
        "band", F.coalesce(F.floor(F.log2("_n")).cast("int") + 1, F.lit(0))))
    need = F.greatest(F.ceil(F.col("n_sigs") * F.lit(float(min_match)) - F.lit(1e-9)), F.lit(1))
    bands = banded.groupBy("preset_id", "n_sigs", "band").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(
        Window.partitionBy("preset_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = bands.withColumn("_before", before).where(F.col("_before") < F.col("n_sigs") - need + 1)
    probes = banded.where("band > 0").join(chosen.select("preset_id", "band"), ["preset_id", "band"], "left_semi")
    cand = salted_join(rep_sigs, probes.select("preset_id", *place, "sig"), place + ["sig"], ["rep"]).select("preset_id", "rep").distinct()
    hits = (cand.join(banded.select("preset_id", "sig", "n_sigs"), "preset_id").join(rep_sigs.select("rep", "sig"), ["rep", "sig"])
            .groupBy("preset_id", "rep", "n_sigs").agg(F.count(F.lit(1)).alias("n_hits")))
    hits = hits.where(F.col("n_hits") >= need)
    found = hits.join(members.select("container_id", "rep"), "rep").select(
        "preset_id", "container_id", "n_hits", "n_sigs", (F.col("n_hits") / F.col("n_sigs")).alias("score"))
    return found.unionByName(empty_presets(presets, banded, containers, place))


def route_containers(scored: DataFrame, preset_kind: str, min_match=0.5, force: bool = False,
                     uniform_format: str = None, copy_skips: bool = False) -> DataFrame:
    """R4. scored: container_id, kind, score. Adds action (apply, uniform, skip, copy), rc and copied.

    A different kind is skipped; grouped containers apply without a score; below min_match the uniform
    rule applies when forced and not 'keep'."""
    same_kind = F.col("kind") == preset_kind
    fits = (F.col("kind") == "chara") | (F.col("score") >= min_match)
    forced = bool(force and uniform_format and uniform_format != "keep")
    action = (F.when(same_kind & fits, F.lit("apply"))
              .when(same_kind & F.lit(forced), F.lit("uniform"))
              .otherwise(F.lit("copy" if copy_skips else "skip")))
    return (scored.withColumn("action", action)
            .withColumn("rc", F.when(F.col("action") == "skip", F.lit(6)).otherwise(F.lit(0)))
            .withColumn("copied", F.col("action") == "copy"))


def _rule_sigs(asset_rules: DataFrame) -> DataFrame:
    return asset_rules.select("preset_id", "rule_no", F.explode("sigs").alias("sig")).distinct()


def _with_preset(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Tag rows of a container with the preset(s) that run on it."""
    return df if runs is None else df.join(runs.select("container_id", "preset_id").distinct(), "container_id")


def _id_pairs(assets: DataFrame, rules: DataFrame, runs: DataFrame, *cols) -> DataFrame:
    """Assets joined to the rules (with ``cols``) that carry their id; ids compare as text."""
    by = ["_id"] + ([] if runs is None else ["preset_id"])
    named = _with_preset(assets.select(*ASSET_KEY, F.col("asset_id").cast("string").alias("_id")), runs)
    r = rules.select("preset_id", F.col("asset_id").cast("string").alias("_id"), *cols)
    return named.join(r, by).select(*ASSET_KEY, "preset_id", *[c for c in r.columns if c not in ("preset_id", "_id")])


def _id_only(named: DataFrame, sigs: DataFrame) -> DataFrame:
    """Id pairs that count: the rule has no signatures, or the asset has none."""
    return named.where("_bare").unionByName(named.where("not _bare").join(sigs, ASSET_KEY, "left_anti"))


def _bare():
    return F.coalesce(F.size("sigs"), F.lit(0)) <= 0


def match_asset_rules(assets: DataFrame, sigs: DataFrame, asset_rules: DataFrame, runs: DataFrame = None) -> DataFrame:
    """Distinct (container_id, asset_id, preset_id, rule_no) hits. A common signature is a hit;
    equal ids are one only when either side has no signatures at all.

    assets: container_id, asset_id; sigs: container_id, asset_id, sig (long form); runs: container_id,
    preset_id limits which presets meet which container (None: every preset meets every container)."""
    by = ["sig"] + ([] if runs is None else ["preset_id"])
    by_sig = _with_preset(sigs, runs).join(_rule_sigs(asset_rules), by).select(*ASSET_KEY, "preset_id", "rule_no")
    by_id = _id_only(_id_pairs(assets, asset_rules, runs, "rule_no", _bare().alias("_bare")), sigs)
    return by_sig.unionByName(by_id.select(*ASSET_KEY, "preset_id", "rule_no")).distinct()


def _merge_cols(r):
    return [F.min(F.struct(format_rank(r["format"]).alias("rank"), r["format"].alias("format"))).alias("_f"),
            F.max(r["size"]).alias("_s")]


def merge_preset_hits(hits: DataFrame, asset_rules: DataFrame) -> DataFrame:
    """R3 on hit rows: lowest format rank and largest size over the hits of an asset; other fields
    follow the global setting again."""
    r = hits.join(asset_rules.select("preset_id", "rule_no", "rule"), ["preset_id", "rule_no"])
    best = r.groupBy(*ASSET_KEY).agg(*_merge_cols(F.col("rule")), F.count(F.lit(1)).alias("n_hits"))
    return best.select(*ASSET_KEY, rule(F.col("_f.format"), F.col("_s")).alias("asset_rule"), "n_hits")


def preset_asset_rules(assets: DataFrame, sigs: DataFrame, asset_rules: DataFrame, runs: DataFrame = None) -> DataFrame:
    """R3 without listing hits (J8): rules are merged per (preset, signature) and per (preset, id) before
    they meet the assets, so an asset signature joins at most one row per preset however many rules
    share it. Minimum and maximum do not care about the order of merging."""
    rs = asset_rules.select("preset_id", F.explode("sigs").alias("sig"), "rule")
    per_sig = rs.groupBy("preset_id", "sig").agg(*_merge_cols(F.col("rule")))
    per_id = asset_rules.groupBy("preset_id", "asset_id", _bare().alias("_bare")).agg(*_merge_cols(F.col("rule")))
    by = ["sig"] + ([] if runs is None else ["preset_id"])
    by_sig = _with_preset(sigs, runs).join(per_sig, by).select(*ASSET_KEY, "_f", "_s")
    by_id = _id_only(_id_pairs(assets, per_id, runs, "_bare", "_f", "_s"), sigs)
    best = by_sig.unionByName(by_id.select(*ASSET_KEY, "_f", "_s")).groupBy(*ASSET_KEY).agg(
        F.min("_f").alias("_f"), F.max("_s").alias("_s"))
    return best.select(*ASSET_KEY, rule(F.col("_f.format"), F.col("_s")).alias("asset_rule"))


def missed_rules(asset_rules: DataFrame, hits: DataFrame, sigs: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_id, preset_id, rule_no) of rules that found nothing on a container.

    containers: container_id, preset_id says which preset runs on which container. A rule counts as
    found when an asset *with the rule's id* got any rule, or when one of its signatures exists on the
    container, even if that match was not used."""
    want = containers.select("container_id", "preset_id").join(
        asset_rules.select("preset_id", "rule_no", F.col("asset_id").cast("string").alias("_id")), "preset_id")
    used = hits.select("container_id", F.col("asset_id").cast("string").alias("_id")).distinct()
    seen = (_with_preset(sigs.select("container_id", "sig").distinct(), containers)
            .join(_rule_sigs(asset_rules), ["preset_id", "sig"]).select("container_id", "preset_id", "rule_no").distinct())
    left = want.join(used, ["container_id", "_id"], "left_anti")
    return left.join(seen, ["container_id", "preset_id", "rule_no"], "left_anti").select(
        "container_id", "preset_id", "rule_no")


def build_presets(bindings: DataFrame, owner_rules: DataFrame = None, asset_rules: DataFrame = None,
                  kind: str = "clothes", min_match: float = 0.5, uniform=None) -> dict:
    """One preset per container of ``bindings``; preset_id is the container_id as text.

    Tables: presets, sigs (fingerprint, long form), owner_rules (only owners the container has) and
    asset_rules with the signatures the asset has on that container (bounded by its own bindings).
    asset_rules: container_id, asset_id, rule. ``min_match`` above 1 is a percentage."""
    grouped = kind == "chara"
    pid = F.col("container_id").cast("string").alias("preset_id")
    level = min_match / 100.0 if min_match > 1 else float(min_match)
    out = {
        "presets": bindings.select(pid).distinct().select(
            "preset_id", F.col("preset_id").alias("source"), F.lit(kind).alias("kind"), F.lit(level).alias("min_match"),
            (no_rule() if uniform is None else uniform).alias("uniform")),
        "sigs": fingerprint(bindings, grouped).select(pid, "sig"),
    }
    if owner_rules is not None:
        owners = bindings.select("container_id", "owner_key").distinct()
        out["owner_rules"] = owners.join(owner_rules.select("owner_key", "rule"), "owner_key").select(
            pid, "owner_key", "rule")
    if asset_rules is not None:
        per = asset_signatures(bindings, grouped).groupBy(*ASSET_KEY).agg(F.array_sort(F.collect_set("sig")).alias("sigs"))
        rows = asset_rules.select(*ASSET_KEY, "rule").join(per, ASSET_KEY, "left")
        out["asset_rules"] = rows.select(
            pid, F.col("asset_id").cast("int").alias("rule_no"), F.col("asset_id").cast("string").alias("asset_id"),
            F.coalesce("sigs", F.array().cast("array<string>")).alias("sigs"), "rule")
    return out


def infer_kind(owner_rules: DataFrame) -> DataFrame:
    """A preset with any group x slot key is for grouped containers."""
    return owner_rules.groupBy("preset_id").agg(
        F.when(F.max("owner_key") >= 100000, F.lit("chara")).otherwise(F.lit("clothes")).alias("kind"))


def apply_preset_owners(parts: DataFrame, owner_rules: DataFrame) -> DataFrame:
    """R21, owners: parts with assets take the preset's rule; those it does not name become keep and
    disabled; parts without assets are left alone (no row)."""
    r = owner_rules.select("owner_key", F.col("rule").alias("_r"))
    used = parts.where("n_assets > 0").join(r, "owner_key", "left")
    has = F.col("_r").isNotNull()
    return used.select("container_id", "owner_key",
                       F.coalesce(has & (F.col("_r.format") != "keep"), F.lit(False)).alias("enabled"),
                       F.when(has, F.col("_r.format")).otherwise(F.lit("keep")).alias("format"),
                       F.when(has & (F.col("_r.size") > 0), F.col("_r.size")).otherwise(F.lit(0)).alias("size"))


def apply_preset_assets(assets: DataFrame, sigs: DataFrame, asset_rules: DataFrame, runs: DataFrame = None) -> DataFrame:
    """R21, assets: the rule with the highest number wins, as later entries overwrite earlier ones.

    Only the highest rule number per (preset, signature) and (preset, id) can win, so rules collapse to
    that before the join."""
    top = asset_rules.select("preset_id", "rule_no", F.explode("sigs").alias("sig")).groupBy("preset_id", "sig").agg(
        F.max("rule_no").alias("rule_no"))
    ids = asset_rules.groupBy("preset_id", "asset_id").agg(F.max("rule_no").alias("rule_no"))
    by = ["sig"] + ([] if runs is None else ["preset_id"])
    by_sig = _with_preset(sigs, runs).join(top, by).select(*ASSET_KEY, "preset_id", "rule_no")
    hits = by_sig.unionByName(_id_pairs(assets, ids, runs, "rule_no").select(*ASSET_KEY, "preset_id", "rule_no"))
    last = hits.groupBy(*ASSET_KEY, "preset_id").agg(F.max("rule_no").alias("rule_no"))
    return last.join(asset_rules.select("preset_id", "rule_no", "rule"), ["preset_id", "rule_no"])


def preset_counts(asset_rules: DataFrame, sigs: DataFrame, assets: DataFrame, runs: DataFrame = None) -> DataFrame:
    """R21 counters per preset and container: hits (asset x rule) and rules without any target. With ``runs``
    (container_id, preset_id) a container without any hit has its row too: no hit, all rules missed."""
    return rule_units.preset_counts(assets, sigs, asset_rules, runs)
