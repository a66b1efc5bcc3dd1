"""Preset rules by class: the same results as pairs of assets and rules, and no such pairs in an exchange."""
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F
from test_facts import small_case
from test_streaming_and_scale import plan

from assetlake.operators import assets as A
from assetlake.operators import presets as P
from assetlake.operators import rule_units as U
from assetlake.registry import QUERIES

RULES = "preset_id string, rule_no int, asset_id string, sigs array<string>, rule struct<format:string,size:int>"


def shuffled_rows(df):
    """Rows written to exchanges by the plan of ``df`` once it has run."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        own = p.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(walk(p.children().apply(i)) for i in range(p.children().size()))
    return walk(df._jdf.queryExecution().executedPlan())


def joined_rows(df):
    """Rows that the joins of ``df`` put out once it has run."""
    df.collect()

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        own = p.metrics().apply("numOutputRows").value() if name.endswith("JoinExec") else 0
        return own + sum(walk(p.children().apply(i)) for i in range(p.children().size()))
    return walk(df._jdf.queryExecution().executedPlan())


def alike(spark, n_rules=400):
    """20 containers of 20 assets, all with one signature; one preset whose rules all carry it, and one rule that doesn't."""
    assets = spark.range(400).select((F.col("id") % 20).alias("container_id"), F.col("id").alias("asset_id"))
    sigs = assets.withColumn("sig", F.lit("x"))
    rules = spark.createDataFrame([("p", k, f"r{k}", ["x"] if k else [], ("png", k)) for k in range(n_rules)], RULES)
    runs = assets.select("container_id", F.lit("p").alias("preset_id")).distinct()
    return assets, sigs, rules, runs


def test_missed_counts_list_no_rules(spark):
    assets, sigs, rules, runs = alike(spark)
    out = U.missed_counts(assets, sigs, rules, runs)
    assert shuffled_rows(out) < 4000
    assert {tuple(r)[1:] for r in out.collect()} == {("p", 400, 1)} and out.count() == 20


def test_missed_rules_unfold_last(spark):
    assets, _, rules, runs = alike(spark)
    out = U.missed_rules(assets, assets.withColumn("sig", F.lit("y")), rules, runs)
    assert shuffled_rows(out) < 6000 and out.count() == 20 * 400


def test_missed_rules_meet_runs_once(spark):
    assets, _, rules, runs = alike(spark)
    out = U.missed_rules(assets, assets.withColumn("sig", F.lit("y")), rules, runs)
    assert plan(out).count("Range") <= 2  # the list of runs; hits are read as written


def test_preset_counts_list_no_rules(spark):
    assets, sigs, rules, runs = alike(spark)
    out = P.preset_counts(rules, sigs, assets, runs)
    assert shuffled_rows(out) < 4000
    assert {tuple(r)[1:] for r in out.collect()} == {("p", 20 * 399, 1)}


def test_merged_hits_list_no_rules(spark):
    assets, sigs, rules, runs = alike(spark)
    out = U.merge_hits(assets, sigs, rules, runs)
    assert shuffled_rows(out) < 4000
    assert {(r.asset_rule.size, r.n_hits) for r in out.collect()} == {(399, 399)} and out.count() == 400


def test_hits_unfold_last(spark):
    assets, sigs, rules, runs = alike(spark, 2500)  # more rules than a chunk
    out = U.match_asset_rules(assets, sigs, rules, runs)
    assert shuffled_rows(out) < 10000 and out.count() == out.distinct().count() == 400 * 2499


def mixed_case(spark, seed):
    """As small_case, with rules whose rows differ in signatures and ids, an asset listed twice, and repeated runs."""
    assets, b, rules = small_case(spark, seed)
    r = random.Random(seed)
    more = rules.where("rule_no % 3 = 0").select("preset_id", "rule_no", F.lit(str(r.randrange(30))).alias("asset_id"),
                                                 F.when(F.col("rule_no") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("?"))).alias("sigs"), "rule")
    again = rules.where("rule_no % 5 = 0").withColumn("sigs", F.array().cast("array<string>"))
    return assets.unionByName(assets.limit(1)), A.asset_signatures(b), rules.unionByName(more).unionByName(again)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("with_runs", [True, False])
def test_units_give_what_pairs_give(spark, seed, with_runs):
    assets, sigs, rules = mixed_case(spark, seed)
    runs = spark.createDataFrame([(c, f"p{(c + i) % 4}") for c in range(9) for i in (0, 1, 1)], "container_id long, preset_id string") if with_runs else None
    hits = P.match_asset_rules(assets, sigs, rules, runs)
    assert rows(U.match_asset_rules(assets, sigs, rules, runs)) == rows(hits) and hits.count() > 20
    assert rows(U.merge_hits(assets, sigs, rules, runs)) == rows(P.merge_preset_hits(hits, rules))
    named = P._with_preset(assets, runs).join(rules.select(*(["preset_id"] if with_runs else []), F.col("asset_id").cast("long").alias("asset_id"), F.col("rule_no"),
                                                            *([] if with_runs else ["preset_id"])), ["asset_id"] + (["preset_id"] if with_runs else []))
    every = hits.unionByName(named.select(*hits.columns)).distinct()
    total = rules.groupBy("preset_id").agg(F.count_distinct("rule_no").alias("n"))
    want = every.groupBy("container_id", "preset_id").agg(F.count(F.lit(1)).alias("h"), F.count_distinct("rule_no").alias("f")).join(total, "preset_id")
    got = U.preset_counts(assets, sigs, rules, runs).where("n_hits > 0")
    assert rows(got) == rows(want.select("container_id", "preset_id", F.col("h").alias("n_hits"), (F.col("n") - F.col("f")).alias("n_missed")))
    if with_runs:
        rules = small_case(spark, seed)[2]  # the plain form takes each row of a rule on its own
        missed = P.missed_rules(rules, P.match_asset_rules(assets, sigs, rules, runs), sigs, runs).distinct()
        assert rows(U.missed_rules(assets, sigs, rules, runs)) == rows(missed)
        counts = {(r.container_id, r.preset_id): r.n_missed for r in U.missed_counts(assets, sigs, rules, runs).collect()}
        listed = {tuple(r)[:2]: r["count"] for r in missed.groupBy("container_id", "preset_id").count().collect()}
        assert {k: v for k, v in counts.items() if v} == listed


def test_a_signature_of_every_preset_is_counted_once(spark):
    sigs = spark.range(100 * 30).selectExpr("id % 100 as container_id", "concat('s', floor(id / 100)) as sig")
    own = spark.range(40 * 30).selectExpr("concat('p', id % 40) as preset_id", "concat('s', floor(id / 40)) as sig")
    out = P.match_score(own.unionByName(spark.createDataFrame([("p0", "far"), ("p1", "s3")], own.schema)), sigs.unionByName(sigs))
    assert joined_rows(out) < 40000  # 120,000 hits of a signature of a container with a preset
    score = {(r.preset_id, r.container_id): (r.n_hits, r.n_sigs) for r in out.collect()}
    assert len(score) == 100 * 40 and score["p0", 5] == (30, 31) and score["p1", 99] == (30, 30)


def test_masked_rules_lie_with_their_assets(spark, small):
    assert plan(QUERIES["R1_resolve_masked"](spark, small)).count("Exchange hashpartitioning") == 0
