"""Pixel-grid operators against brute force on small images."""
import math

import numpy as np
from pyspark.sql import functions as F

from assetlake.functions import sizes
from assetlake.operators import grid as G


def table(spark, images):
    rows = [(k, y, x, *[int(c) for c in (v if isinstance(v, tuple) else (v, v, v, 255))], len(r), len(im))
            for k, im in images.items() for y, r in enumerate(im) for x, v in enumerate(r)]
    return spark.createDataFrame(rows, "img_id string, y int, x int, r int, g int, b int, a int, width int, height int")


def back(df, col="r"):
    out = {}
    for r in df.collect():
        out.setdefault(r.img_id, {})[r.y, r.x] = r[col]
    return out


def alpha(n, f):
    return [[(9, 9, 8, f(y, x)) for x in range(n)] for y in range(n)]


def test_pixel_profile_cases(spark):
    n = 32
    inside = lambda y, x: ((x + .5) / n * 2 - 1) ** 2 + ((y + .5) / n * 2 - 1) ** 2 <= 1
    p = table(spark, {
        "opaque": alpha(n, lambda y, x: 255), "230": alpha(n, lambda y, x: 230), "127": alpha(n, lambda y, x: 127),
        "corners": alpha(n, lambda y, x: 255 if inside(y, x) else 0),
        "hole": alpha(n, lambda y, x: 0 if (y, x) == (16, 16) else 255),
        "jitter": alpha(n, lambda y, x: 254)})
    got = {r.img_id: (r.flat_alpha, r.placeholder_alpha, r.circle_only) for r in G.pixel_profile(p).collect()}
    assert got == {"opaque": (True, False, True), "230": (False, False, False), "127": (False, True, False),
                   "corners": (False, False, True), "hole": (False, False, True), "jitter": (False, False, True)}
    early = {r.img_id: (r.placeholder_alpha, r.circle_only) for r in G.pixel_profile(p, True).collect()}
    assert early["127"] == (True, False) and early["corners"] == (False, True)


def test_structured_mean_equals_plain_mean_on_balanced_blocks(spark):
    n = 8
    ims = {
        "step": [[255 if x >= 4 else 0 for x in range(n)] for _ in range(n)],
        "check": [[255 * ((x + y) % 2) for x in range(n)] for y in range(n)],
        "ramp": [[x * 30 for x in range(n)] for _ in range(n)],
        "flat": [[77] * n for _ in range(n)],
    }
    p = table(spark, ims)
    assert back(G.block_mean_structured(p, 4, 4, 1.0)) == back(G.block_mean(p, 4, 4))
    line = table(spark, {"line": [[255 if x == 1 else 0 for x in range(4)] for _ in range(4)]})
    assert back(G.block_mean(line, 4, 4))["line"] == {(0, 0): 64}
    peak = back(G.block_mean_structured(line, 4, 4, 1.0))["line"][0, 0]
    assert peak == 64 + round((1 - 2 * 4 / 16) * (255 - 64))


def test_area_weights_sum_to_one_and_preserve_flat(spark):
    p = table(spark, {"flat": [[93] * 10 for _ in range(7)]})
    for out in (G.area_resample(p, 3, 5), G.kernel_upscale(p, 13, 9), G.kernel_upscale(p, 11, 7, "mitchell")):
        assert set(back(out)["flat"].values()) == {93}
    sizes_df = spark.createDataFrame([(10, 3), (7, 5), (64, 24)], "src_n int, dst_n int")
    w = G.axis_weights(sizes_df, G._taps_area).groupBy("src_n", "dst_n", "d").agg(F.sum("w").alias("s"))
    assert all(abs(r.s - 1) < 1e-9 for r in w.collect())


def test_mixed_sizes_in_one_table(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (6, 9)), rng.integers(0, 256, (5, 4))
    p = table(spark, {"a": a.tolist(), "b": b.tolist()})
    got = back(G.guided_smooth(p, 1, 0.01))
    for k, im in (("a", a), ("b", b)):
        f = im.astype(float)

        def box(v):
            q = np.pad(v, 1, mode="edge")
            h, w = v.shape
            return sum(q[i:i + h, j:j + w] for i in range(3) for j in range(3)) / 9
        m = box(f)
        var = np.maximum(box(f * f) - m * m, 0)
        A = var / (var + 0.01 * 255 * 255)
        out = np.clip(np.rint(np.round(box(A) * f + box(m - A * m), 6)), 0, 255)
        assert all(got[k][y, x] == out[y, x] for y in range(im.shape[0]) for x in range(im.shape[1]))


def test_sharpeners_leave_tiny_images_alone(spark):
    p = table(spark, {"t": [[1, 200], [90, 4]]})
    want = back(p)
    assert back(G.unsharp(p, 1.0)) == want and back(G.cas(p, 2.0)) == want and back(G.guided_smooth(p, 3)) == want


def test_box_resize_and_rgbe_round_trip(spark):
    p = table(spark, {"i": [[10 * x + y for x in range(5)] for y in range(4)]})
    got = back(G.box_resize(p, 2, 3))["i"]
    im = np.array([[10 * x + y for x in range(5)] for y in range(4)], float)
    for y in range(3):
        y0, y1 = int(y * 4 / 3), min(4, max(int(y * 4 / 3) + 1, int((y + 1) * 4 / 3)))
        for x in range(2):
            x0, x1 = int(x * 2.5), min(5, max(int(x * 2.5) + 1, int((x + 1) * 2.5)))
            assert abs(got[y, x] - im[y0:y1, x0:x1].mean()) < 1e-9
    d = spark.createDataFrame([(r, g, b, e) for r, g, b, e in [(255, 3, 0, 128), (128, 255, 7, 140), (1, 1, 200, 100), (0, 0, 0, 0)]],
                              "r int, g int, b int, e int")
    lin = [sizes.rgbe_to_linear(F.col(c), F.col("e")).alias("l" + c) for c in "rgb"]
    t = d.select("r", "g", "b", "e", *lin)
    o = sizes.linear_to_rgbe(*[F.col("l" + c) for c in "rgb"])
    for r in t.select("r", "g", "b", "e", o.alias("o")).collect():
        assert (r.r, r.g, r.b, r.e) == tuple(r.o)


def test_predictors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    im = rng.integers(0, 256, (5, 6))
    im[2] = im[1]
    p = table(spark, {"i": im.tolist()})
    got = {r.y: (r.predictor, r.score) for r in G.predictor_choice(p, ["r"]).collect()}
    for y in range(5):
        best = None
        for f in range(5):
            s = 0
            for x in range(6):
                a = int(im[y, x - 1]) if x else 0
                b = int(im[y - 1, x]) if y else 0
                c = int(im[y - 1, x - 1]) if x and y else 0
                q = a + b - c
                pa, pb, pc = abs(q - a), abs(q - b), abs(q - c)
                pred = [0, a, b, (a + b) >> 1, a if pa <= pb and pa <= pc else (b if pb <= pc else c)][f]
                v = (int(im[y, x]) - pred) & 255
                s += min(v, 256 - v)
            if best is None or s < best[1]:
                best = (f, s)
        assert got[y] == best


def test_entropy(spark):
    h = spark.createDataFrame([("g", "a", 4), ("g", "b", 4), ("u", "x", 9)], "k string, s string, n long")
    got = {r.k: r.entropy_bytes for r in G.entropy_bytes(h, ["k"]).collect()}
    assert math.isclose(got["g"], 1.0) and math.isclose(got["u"], 0.0, abs_tol=1e-9)


def test_blockiness_small_is_zero_and_grid_is_positive(spark):
    n = 32
    p = table(spark, {"small": [[0] * 31 for _ in range(31)], "blocky": [[(x // 8 + y // 8) % 2 * 90 for x in range(n)] for y in range(n)]})
    got = {r.img_id: r.blockiness for r in G.blockiness(p, compat_shift=False).collect()}
    assert got["small"] == 0 and got["blocky"] == 90


def test_blockiness_by_brute_force(spark):
    rng = np.random.default_rng(3)
    w, h = 40, 300
    px = rng.integers(0, 256, (h, w, 3)).astype(int)
    rows = [("i", y, x, *map(int, px[y, x]), 255) for y in range(h) for x in range(w)]
    df = G.with_sizes(spark.createDataFrame(rows, "img_id string, y int, x int, r int, g int, b int, a int"))
    weighted = px[:, :, 2] * 28 + px[:, :, 1] * 151 + px[:, :, 0] * 77
    for compat in (True, False):
        def step(a, b, vertical):
            return a >> ((8 - b) & 31) >> 8 if vertical and compat else abs((a >> 8) - (b >> 8))
        edge, inner = [], []
        for y in range(4, h):
            edge += [step(int(weighted[y, x]), int(weighted[y, x - 1]), False) for x in range(8, w, 8)]
            inner += [step(int(weighted[y, x + 4]), int(weighted[y, x + 3]), False) for x in range(8, w, 8) if x + 4 < w]
        for x in range(4, w):
            edge += [step(int(weighted[y, x]), int(weighted[y - 1, x]), True) for y in range(8, h, 8)]
            inner += [step(int(weighted[y + 4, x]), int(weighted[y + 3, x]), True) for y in range(8, h, 8) if y + 4 < h]
        got = G.blockiness(df, compat_shift=compat).first().blockiness
        assert math.isclose(got, sum(edge) / len(edge) - sum(inner) / len(inner), rel_tol=1e-9)


def test_process_grid_denoise_only_touches_reduced_images(spark):
    rng = np.random.default_rng(5)
    p = table(spark, {k: rng.integers(0, 256, (16, 16)).tolist() for k in ("same", "half", "grow")})
    rules = spark.createDataFrame([("same", 16, 16), ("half", 8, 8), ("grow", 20, 20)], "img_id string, new_width int, new_height int")
    out = back(G.process_grid(p, rules, denoise="all", sharpen=None))
    assert out["same"] == back(p)["same"]
    assert out["half"] == back(G.guided_smooth(G.with_sizes(G.block_mean(p.where("img_id = 'half'"), 2, 2))))["half"]
    assert out["grow"] == back(G.kernel_upscale(p.where("img_id = 'grow'"), 20, 20))["grow"]
