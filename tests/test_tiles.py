"""Neighbourhood operators on tiles, and the whole grid job: plans, tile borders, branches and options."""
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlake.operators import grid as G
from assetlake.operators import tiles as T
from assetlake.registry.views import Views
from test_grid import back, table
from test_streaming_and_scale import plan


def images(seed=7):
    r = np.random.default_rng(seed)
    return {k: [[tuple(int(c) for c in r.integers(0, 256, 4)) for _ in range(w)] for _ in range(h)]
            for k, h, w in (("wide", 7, 41), ("tall", 33, 6), ("exact", 20, 20), ("tiny", 2, 9))}


OPERATORS = {
    "unsharp": lambda p, tile: T.unsharp(p, 0.7, alpha=True, tile=tile),
    "edge": lambda p, tile: T.unsharp(p, 0.7, k_edge=2.0, premul=True, tile=tile),
    "cas": lambda p, tile: T.cas(p, 1.5, alpha=True, tile=tile),
    "smooth": lambda p, tile: T.guided_smooth(p, 2, 0.02, tile=tile),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_tiles_do_not_change_results(spark, name):
    p = table(spark, images())
    whole, cut = (sorted(map(tuple, OPERATORS[name](p, tile).collect())) for tile in (256, 5))
    assert whole == cut and len(whole) == 7 * 41 + 33 * 6 + 400 + 18


def test_blockiness_does_not_depend_on_tiles(spark):
    r = np.random.default_rng(1)
    p = table(spark, {"a": r.integers(0, 256, (40, 50)).tolist(), "b": r.integers(0, 256, (33, 32)).tolist()})
    a, b = ({x.img_id: round(x.blockiness, 9) for x in T.blockiness(p, 2, 3, tile=t).collect()} for t in (256, 7))
    assert a == b and len(a) == 2


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)", plan(df))


@pytest.mark.parametrize("name", ["unsharp", "cas", "smooth"])
def test_one_exchange_by_tile(spark, small, name):
    found = exchanges(OPERATORS[name](Views(spark, small).px, 256))
    assert len(found) == 1 and re.match(r"img_id#\d+L?, _ty#\d+L?, _tx#\d+", found[0])
    p = plan(OPERATORS[name](Views(spark, small).px, 256))
    assert all("_ty" in w and "_tx" in w for w in re.findall(r"windowspecdefinition\(([^)]*)\)", p)) and "Join" not in p


def test_smoothing_and_sharpening_share_the_exchange_and_the_scans(spark, small):
    v = Views(spark, small)
    rules = v.embeddings.select(F.col("vec_id").alias("img_id"), F.lit(4).alias("new_width"), F.lit(4).alias("new_height"))
    p = plan(G.process_grid(v.px, rules, denoise="all", sharpen="cas"))
    assert p.count("Scan parquet") <= 2 * 4  # the pixels at most four times, with the rules made from the same table
    assert len([x for x in exchanges(G.process_grid(v.px, rules, denoise="all")) if "_ty" in x]) == 1


def test_structured_mean_gathers_nothing(spark, small):
    p = plan(G.block_mean_structured(Views(spark, small).px, 8, 8))
    assert "collect_list" not in p and "Join" not in p


def test_sizes_are_asked_for(spark):
    with pytest.raises(ValueError, match="width"):
        T.cas(table(spark, {"a": [[1]]}).drop("width"), 1.0)


def test_branches_of_the_whole_job(spark):
    r = np.random.default_rng(5)
    ims = {k: [[tuple(int(c) for c in r.integers(0, 256, 4)) for _ in range(16)] for _ in range(16)] for k in ("same", "half", "part", "grow", "plain")}
    p = table(spark, ims)
    rules = spark.createDataFrame([("same", 16, 16, True, True), ("half", 8, 8, None, True), ("part", 10, 7, True, None), ("grow", 20, 24, True, False),
                                   ("plain", 8, 8, False, False)], "img_id string, new_width int, new_height int, detail boolean, pack boolean")
    one = lambda k: p.where(F.col("img_id") == k)
    for gamma in (0.0, 0.7):
        for premul in (False, True):
            out = G.process_grid(p, rules, sharpen=None, gamma=gamma, premul=premul)
            got = {c: back(out, c) for c in ("r", "a", "gray", "b")}
            block = G.block_mean_structured(one("half"), 2, 2, gamma, premul) if gamma else G.block_mean(one("half"), 2, 2, premul)
            for k, want in {"same": one("same"), "half": block, "part": G.area_resample(one("part"), 10, 7, premul),
                            "grow": G.kernel_upscale(one("grow"), 20, 24, premul=premul),
                            "plain": G.kernel_upscale(one("plain"), 8, 8, "catmull", premul)}.items():
                assert got["r"][k] == back(want)[k] and got["a"][k] == back(want, "a")[k], (k, gamma, premul)
                assert got["gray"][k] == (got["b"][k] if k in ("same", "half") else {at: None for at in got["b"][k]})


def test_denoise_skips_plain_reductions_and_clean_sources(spark):
    n = 32
    blocky = [[(x // 8 + y // 8) % 2 * 90 for x in range(n)] for y in range(n)]
    clean = [[(x * 7 + y) % 200 for x in range(n)] for y in range(n)]
    p = table(spark, {"blocky": blocky, "clean": clean, "plain": blocky})
    rules = spark.createDataFrame([("blocky", True), ("clean", True), ("plain", False)], "img_id string, detail boolean").withColumns(
        {"new_width": F.lit(16), "new_height": F.lit(16)})
    out = back(G.process_grid(p, rules, denoise="dirty", dirty=0.5, sharpen=None))
    raw = back(G.process_grid(p, rules, sharpen=None))
    assert out["clean"] == raw["clean"] and out["plain"] == raw["plain"] and out["blocky"] != raw["blocky"]
    assert out["blocky"] == back(G.guided_smooth(G.with_sizes(G.block_mean(p.where("img_id = 'blocky'"), 2, 2))))["blocky"]
    sharp = back(G.process_grid(p, rules, denoise="dirty", sharpen="edge", strength=0.6, k_edge=2.0, tile=6))
    assert sharp == back(G.process_grid(p, rules, denoise="dirty", sharpen="edge", strength=0.6, k_edge=2.0))


def test_alpha_is_sharpened_only_on_demand(spark):
    p = table(spark, {"a": images()["exact"]})
    rules = spark.createDataFrame([("a", 10, 10)], "img_id string, new_width int, new_height int")
    plain, kept, sharp = (back(G.process_grid(p, rules, sharpen=s, strength=2.0, alpha=a), "a") for s, a in ((None, False), ("cas", False), ("cas", True)))
    assert kept == plain and sharp != plain
