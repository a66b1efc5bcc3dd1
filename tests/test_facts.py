"""The co-partitioned store and joins on frequent signatures: plans, equal results, one signature on every container."""
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from assetlake.operators import assets as A
from assetlake.operators import facts as FT
from assetlake.operators import presets as P
from assetlake.operators import skew
from assetlake.registry import QUERIES
from assetlake.registry.views import Views
from test_streaming_and_scale import plan


def shape(df):
    p = plan(df)
    return p.count("Exchange hashpartitioning"), p.count("lineitem.parquet")


@pytest.mark.parametrize("name,exchanges,scans", [("R1_resolve_rules", 8, 2), ("R2_merge_owner_rules", 0, 0), ("J8_match_asset_rules", 4, 0),
                                                  ("J11_similar_containers", 30, 3)])
def test_layers_meet_in_place(spark, small, name, exchanges, scans):
    got = shape(QUERIES[name](spark, small))
    assert got[0] <= exchanges and got[1] <= scans


def test_signatures_meet_the_few_presets_where_they_lie(spark, small, monkeypatch):
    own = []
    real = P.similar_containers
    monkeypatch.setattr(P, "similar_containers", lambda p, sigs, *more: own.append(sigs) or real(p, sigs, *more))
    assert QUERIES["J11_similar_containers"](spark, small).count() > 0
    assert "Exchange hashpartitioning" not in plan(own[0])


def test_what_parts_alone_decide_is_made_before_lines_meet_them(spark, small):
    p = plan(Views(spark, small).bindings)
    assert p.count("DetailTex") == 1 and "Join" in p[:p.index("DetailTex")]


def small_case(spark, seed=1):
    r = random.Random(seed)
    assets = [(c, a, 100 * a) for c in range(8) for a in range(30) if r.random() < 0.8]
    bindings = [(c, a, r.choice([1, 2, 4]), 0, r.randrange(4), f"m{r.randrange(5)}", "MainTex") for c, a, _ in assets for _ in range(r.randrange(4))]
    sig = lambda: f"slot{r.randrange(4)}|m{r.randrange(5)}|MainTex"
    b = A.with_owner_key(spark.createDataFrame(bindings, "container_id long, asset_id long, obj_type int, coord_idx int, slot int, material string, property string"))
    known = [x.sig for x in A.asset_signatures(b).select("sig").distinct().collect()]
    rules = [(f"p{r.randrange(3)}", k, str(r.randrange(30)), r.sample(known, r.randrange(3)) if r.random() < 0.9 else None,
              (r.choice(["png", "keep", "auto", "jpeg", "odd"]), r.choice([0, 512, 1024]), None, None, None, None)) for k in range(40)]
    rules = spark.createDataFrame(rules, "preset_id string, rule_no int, asset_id string, sigs array<string>, rule struct<format:string,size:int,"
                                  "sharpen_pct:int,sharpen_mode:string,gray_a:int,up:int>")
    return spark.createDataFrame(assets, "container_id long, asset_id long, n_bytes long"), b, rules


@pytest.mark.parametrize("with_runs", [True, False])
def test_the_store_gives_what_the_plain_joins_give(spark, with_runs):
    assets, b, rules = small_case(spark)
    runs = spark.createDataFrame([(c, f"p{c % 3}") for c in range(7)], "container_id long, preset_id string") if with_runs else None
    store = FT.write_facts(assets, b, 3)
    sigs = A.asset_signatures(b)
    assert rows(FT.asset_signatures(store)) == rows(sigs)
    want = rows(P.match_asset_rules(assets, sigs, rules, runs))
    assert rows(FT.match_asset_rules(store, rules, runs)) == want and len(want) > 20
    assert rows(FT.preset_asset_rules(store, rules, runs)) == rows(P.preset_asset_rules(assets, sigs, rules, runs))
    FT.drop_facts(store)
    assert not [t for t in spark.catalog.listTables() if t.name == store.assets.inputFiles()[0].rsplit("/", 2)[1]]


def test_missed_rules_as_a_complement(spark):
    assets, b, rules = small_case(spark, 3)
    runs = spark.createDataFrame([(c, f"p{c % 4}") for c in range(9)], "container_id long, preset_id string")
    store, sigs = FT.write_facts(assets, b, 3), A.asset_signatures(b)
    want = rows(P.missed_rules(rules, P.match_asset_rules(assets, sigs, rules, runs), sigs, runs))
    assert rows(FT.missed_rules(store, rules, runs)) == want and len(want) > 10
    counts = {(r.container_id, r.preset_id): (r.n_rules, r.n_missed) for r in FT.missed_counts(store, rules, runs).collect()}
    for (c, p), (n, missed) in counts.items():
        assert n == rules.where(F.col("preset_id") == p).count() and missed == sum(w[:2] == (c, p) for w in want)
    assert len(counts) == 7  # two containers run a preset without rules
    asked = spark.createDataFrame([(1,), (2,)], "container_id long")
    assert rows(FT.missed_rules(store, rules, runs, asked)) == [w for w in want if w[0] in (1, 2)]


def test_the_sweep_meets_profiles_not_assets(spark):
    from assetlake.operators.resolve import builtin_plans
    from assetlake.plans import reports
    n = 500
    assets = spark.range(n).select(F.lit(1).alias("container_id"), F.col("id").alias("asset_id"), F.lit(1000).cast("long").alias("n_bytes"),
                                   F.lit(4000).alias("width"), F.lit(2000).alias("height"))
    b = assets.select("container_id", "asset_id", F.lit("MainTex").alias("property"), F.lit(1).alias("owner_key"))
    inv = {"assets": assets, "bindings": b}
    assert [r.weight for r in reports.asset_profiles(inv).collect()] == [n]
    r = reports.compare_plans(inv, builtin_plans(spark).where("plan_id in ('optimise', 'quality')"), ["optimise", "quality"], protect=False).first()
    assert (r.optimise_changed, r.quality_changed, r.optimise_bytes_after, r.quality_bytes_after) == (n, n, 1000 * n, 262 * n)


def crowd(spark, n=3000):
    """One signature on every container, a few on many, one of its own for each."""
    c = spark.range(n).select(F.col("id").alias("container_id"), F.lit("d").alias("rel_dir"), F.lit("clothes").alias("kind"))
    sigs = F.array(F.lit("all"), F.concat(F.lit("ten"), F.col("container_id") % 10), F.concat(F.lit("own"), F.col("container_id")))
    return c, c.select("container_id", F.explode(sigs).alias("sig"))


def test_a_signature_on_every_container(spark):
    c, sigs = crowd(spark)
    hot = {r._hot: r._salts for r in skew.frequent_keys(sigs, ["sig"], 4).collect()}
    assert hot[spark.range(1).select(F.xxhash64(F.lit("all"))).first()[0]] >= 5 and len(hot) <= 20
    presets = spark.createDataFrame([("common", "d", "clothes"), ("three", "d", "clothes"), ("far", "e", "clothes"), ("none", "d", "clothes")],
                                    "preset_id string, rel_dir string, kind string")
    own = spark.createDataFrame([("common", "all"), ("three", "all"), ("three", "ten3"), ("three", "own13"), ("far", "all")], "preset_id string, sig string")
    score = {(r.preset_id, r.container_id): r.score for r in P.match_score(own, sigs).collect()}
    assert len(score) == 3 * 3000 and score["common", 7] == 1 and score["three", 13] == 1 and abs(score["three", 23] - 2 / 3) < 1e-9
    found = P.similar_containers(presets, own, c, sigs, 0.6).groupBy("preset_id").count().collect()
    assert {r[0]: r[1] for r in found} == {"common": 3000, "three": 300, "none": 3000}


def test_frequent_keys_land_in_many_tasks(spark):
    _, sigs = crowd(spark, 20000)
    few = spark.createDataFrame([("all", 1), ("ten3", 2)], "sig string, x int")
    j = skew.salted_join(sigs, few, ["sig"], ["container_id"])
    assert j.count() == 20000 + 2000 and "_salt" not in j.columns
    assert skew.salted_join(sigs.limit(0), few, ["sig"], ["container_id"]).count() == 0
    assert plan(j).count("BroadcastExchange") >= 2


def test_the_store_drops_repeats_after_its_exchange(spark):
    assets, b, _ = small_case(spark)
    store = FT.write_facts(assets.unionByName(assets), b, 3, repeated=True)
    assert rows(store.assets) == rows(assets) and store.bindings.where("sig is null").count() == 0
    FT.drop_facts(store)
