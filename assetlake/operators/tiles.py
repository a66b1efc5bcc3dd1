"""Neighbourhood operators on tiles: G6, G7, G8, G9, and chains of them.

pixels(img_id, y, x, r, g, b, a, width, height). An image is cut into squares of ``TILE`` pixels. One exchange by (image,
tile row, tile column) brings the pixels of a tile together with a border of its neighbours' pixels, as wide as the
operator reaches; after that every window stays inside one tile. A single image of any size thus spreads over as many tasks
as it has tiles, and no window holds more than one line of a tile. The parts that work on a tiled table (``smooth``,
``sharpen_cas``, ``sharpen_mask``) can follow each other in one exchange when its border is as wide as all of them reach.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlake.functions.sizes import clamp_byte, luma
from assetlake.operators.ordering import hist_quantile

CH = ["r", "g", "b", "a"]
TILE = 256
KEY = ["img_id", "_ty", "_tx"]
PIXEL = ["img_id", "y", "x", *CH, "width", "height"]


def near_value(v: Column) -> Column:
    """Drop the noise of summation order so that ties round the same way on every run."""
    return F.round(v, 6)


def rounded(v: Column) -> Column:
    return F.bround(near_value(v), 0)


def sized(pixels: DataFrame) -> DataFrame:
    """The table itself; every operator that meets edges needs the image's size on each pixel."""
    missing = {"width", "height"} - set(pixels.columns)
    if missing:
        raise ValueError(f"pixels lack {sorted(missing)}; add the image's size, for example with with_sizes")
    return pixels


def with_sizes(pixels: DataFrame) -> DataFrame:
    """For tables that come without sizes: finds them by one aggregate and a join on the image."""
    size = pixels.groupBy("img_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return pixels.join(size, "img_id")


# ---- tiles ------------------------------------------------------------------------------------------------

def _reach(pos: str, size: str, border: int, tile: int) -> Column:
    """The tiles whose area, widened by the border, holds a position."""
    return F.expr(f"sequence(cast(greatest({pos} - {border}, 0) div {tile} as int), cast(least({pos} + {border}, {size} - 1) div {tile} as int))")


def tiled(pixels: DataFrame, border: int, tile: int = TILE) -> DataFrame:
    """Each pixel in its own tile, and in those that see it in their border; one exchange."""
    p = sized(pixels).withColumn("_ty", F.explode(_reach("y", "height", border, tile)))
    p = p.withColumn("_tx", F.explode(_reach("x", "width", border, tile)))
    return p.repartition(*KEY)


def cropped(t: DataFrame, tile: int = TILE) -> DataFrame:
    """The pixels in their own tiles: each once."""
    own = (F.floor(F.col("y") / tile) == F.col("_ty")) & (F.floor(F.col("x") / tile) == F.col("_tx"))
    return t.where(own).drop("_ty", "_tx")


def _line():
    return Window.partitionBy(*KEY, "y").orderBy("x")


def _column():
    return Window.partitionBy(*KEY, "x").orderBy("y")


def _with_near(t: DataFrame, **values: Column) -> DataFrame:
    """Adds ``near``: the values of the 3 x 3 pixels around, as near.up.left.<name> to near.down.right.<name>. At an image's
    edge the edge repeats. One window along lines and one along columns, whatever the number of values."""
    t = t.withColumn("_v", F.struct(*[v.alias(k) for k, v in values.items()]))
    ends = [F.coalesce(f("_v").over(_line()), F.col("_v")).alias(k) for f, k in ((F.lag, "left"), (F.lead, "right"))]
    t = t.withColumn("_h", F.struct(ends[0], F.col("_v").alias("mid"), ends[1])).drop("_v")
    ends = [F.coalesce(f("_h").over(_column()), F.col("_h")).alias(k) for f, k in ((F.lag, "up"), (F.lead, "down"))]
    return t.withColumn("near", F.struct(ends[0], F.col("_h").alias("here"), ends[1])).drop("_h")


ROWS, COLUMNS = ("up", "here", "down"), ("left", "mid", "right")


def _weighted(name: str, rows, columns) -> Column:
    """Sum over the 3 x 3 pixels of value * row weight * column weight."""
    terms = [F.col(f"near.{r}.{c}.{name}") * (v * w) for r, v in zip(ROWS, rows) for c, w in zip(COLUMNS, columns) if v * w]
    total = terms[0]
    for x in terms[1:]:
        total = total + x
    return total


def _tiny(least: int) -> Column:
    return (F.col("width") < least) | (F.col("height") < least)


def _alpha_weighted(c: str) -> Column:
    return F.when(F.col("a") == 255, F.col(c)).otherwise(F.expr(f"cast({c} * a div 255 as int)"))


# ---- G6 ---------------------------------------------------------------------------------------------------

def _gradient() -> Column:
    """Squared gradient of the luminance."""
    across, down = _weighted("l", (1, 2, 1), (-1, 0, 1)), _weighted("l", (-1, 0, 1), (1, 2, 1))
    return across * across + down * down


def _edge_strength(t: DataFrame, tile: int) -> DataFrame:
    """Adds ``ref``, the 95 % quantile (W9) of the image's gradient. It comes back by tile, so pixels are not moved again."""
    g = cropped(t, tile).select("img_id", "width", "height", _gradient().alias("g2"))
    ref = hist_quantile(g, ["img_id", "width", "height"], F.shiftright(F.floor(F.sqrt("g2")).cast("int"), 2))
    count = lambda size: F.explode(F.expr(f"sequence(0, cast(({size} - 1) div {tile} as int))"))
    ref = ref.select("img_id", count("height").alias("_ty"), "width", F.col("quantile").alias("ref"))
    return t.join(ref.select("img_id", "_ty", count("width").alias("_tx"), "ref"), KEY)


def sharpen_mask(t: DataFrame, k: float, k_edge: float = 0.0, alpha: bool = False, premul: bool = False, tile: int = TILE) -> DataFrame:
    """G6 on a tiled table; reaches one pixel."""
    sharp = CH if alpha else CH[:3]
    seen = {c: _alpha_weighted(c) if premul and c != "a" else F.col(c) for c in CH}
    t = _with_near(t, **{c: seen[c] for c in sharp}, l=luma(*[seen[c] for c in CH[:3]]))
    amount = F.lit(float(k))
    if k_edge > k:
        t = _edge_strength(t, tile)
        amount = amount + F.lit(float(k_edge - k)) * F.least(F.sqrt(_gradient()) / 4.0 / F.col("ref"), F.lit(1.0))
    new = {}
    for c in sharp:
        own, blur = F.col(f"near.here.mid.{c}"), F.shiftright(_weighted(c, (1, 2, 1), (1, 2, 1)) + 8, 4)
        v = rounded(own + amount * (own - blur))
        if premul and c != "a":
            v = F.when(F.col("a") < 32, F.col(c)).otherwise(rounded(v * 255.0 / F.greatest(F.col("a"), F.lit(1))))
        new[c] = F.when(_tiny(3), F.col(c)).otherwise(clamp_byte(v)).cast("int")
    return t.withColumns(new).drop("near", "ref")


def unsharp(pixels: DataFrame, k: float, k_edge: float = 0.0, alpha: bool = False, premul: bool = False, tile: int = TILE) -> DataFrame:
    """V + k * (v - blur), blur = 3 x 3 binomial. With k_edge > k the strength grows with the gradient, scaled by its
    95 % quantile for each image (W9). premul works on alpha-weighted colours and leaves pixels with a < 32 untouched."""
    if k <= 0:
        return sized(pixels).select(*PIXEL)
    return cropped(sharpen_mask(tiled(pixels, 1, tile), k, k_edge, alpha, premul, tile), tile).select(*PIXEL)


# ---- G7 ---------------------------------------------------------------------------------------------------

#: The four pixels that are weighed against the centre: both right-hand corners and both sides. Results must reproduce it.
CROSS = ["near.up.right", "near.here.right", "near.down.right", "near.here.left"]


def sharpen_cas(t: DataFrame, strength: float, alpha: bool = False) -> DataFrame:
    """G7 on a tiled table; reaches one pixel.

    A pixel becomes the weighted mean of itself (weight 1) and the cross (weight m each), with m = peak * sqrt(room / high):
    room is what the five values leave to the nearer end of 0..255, so m shrinks where contrast is high already."""
    s = min(strength / 2.5, 4.0)
    if s <= 0:
        return t
    slope = 8.0 - 3.0 * s
    peak = max(-1.0 / slope, -1.0) if slope else -1.0
    sharp = CH if alpha else CH[:3]
    t = _with_near(t, **{c: F.col(c).cast("double") for c in sharp})
    new = {}
    for c in sharp:
        around = [F.col(f"{place}.{c}") for place in CROSS]
        own = F.col(f"near.here.mid.{c}")
        low, high = F.least(own, *around), F.greatest(own, *around)
        m = F.sqrt(F.least(low, 255.0 - high) / high) * F.lit(peak)
        mean = ((around[0] + around[1] + around[2] + around[3]) * m + own) / (m * 4.0 + 1.0)
        new[c] = F.when((high == 0) | _tiny(3), F.col(c)).otherwise(clamp_byte(rounded(mean))).cast("int")
    return t.withColumns(new).drop("near")


def cas(pixels: DataFrame, strength: float, alpha: bool = False, tile: int = TILE) -> DataFrame:
    """Contrast-adaptive sharpening."""
    if strength <= 0:
        return sized(pixels).select(*PIXEL)
    return cropped(sharpen_cas(tiled(pixels, 1, tile), strength, alpha), tile).select(*PIXEL)


# ---- G8 ---------------------------------------------------------------------------------------------------

def blockiness(pixels: DataFrame, row_step: int = 1, col_step: int = 1, compat_shift: bool = True, tile: int = TILE) -> DataFrame:
    """Mean luminance step at 8-pixel boundaries minus the mean step mid-block, on every ``row_step``-th row and
    ``col_step``-th column; images under 32 pixels score 0. (To agree with tools that look at about 256 rows and columns,
    give steps of an image's edges div 256.)

    With ``compat_shift`` a vertical step is what the common formula w1 >> 8 - w0 >> 8 gives on weighted sums w as it
    stands: w1 >> ((8 - w0) & 31) >> 8, as minus binds tighter than a shift. Without it both halves use luminance."""
    weighed = (F.col("b") * 28 + F.col("g") * 151 + F.col("r") * 77).cast("int")
    t = _with_near(tiled(pixels, 1, tile), l=luma(*[F.col(c) for c in CH[:3]]), w=weighed)
    own, up = "near.here.mid", "near.up.mid"
    if compat_shift:
        shift = (F.lit(8) - F.col(f"{up}.w")).bitwiseAND(F.lit(31)).cast("int")
        down = F.shiftright(F.call_function("shiftright", F.col(f"{own}.w"), shift), 8)
    else:
        down = F.abs(F.col(f"{own}.l") - F.col(f"{up}.l"))
    across = F.abs(F.col(f"{own}.l") - F.col("near.here.left.l"))
    x, y = F.col("x"), F.col("y")
    lines = {"across": (across, x, (y >= 4) & ((y - 4) % row_step == 0)), "down": (down, y, (x >= 4) & ((x - 4) % col_step == 0))}
    total = lambda off: [f(F.when(on & (pos >= 8 + off) & (pos % 8 == off), step)) for step, pos, on in lines.values() for f in (F.sum, F.count)]
    names = [f"{k}_{n}{at}" for at in ("edge", "inner") for k in lines for n in ("sum", "n")]
    out = cropped(t, tile).groupBy("img_id", "width", "height").agg(*[c.alias(n) for c, n in zip(total(0) + total(4), names)])
    both = lambda n, at: sum((F.coalesce(f"{k}_{n}{at}", F.lit(0)) for k in lines), F.lit(0))
    mean = {at: both("sum", at) / F.nullif(both("n", at), F.lit(0)) for at in ("edge", "inner")}
    v = F.when(_tiny(32), F.lit(0.0)).otherwise(F.coalesce(mean["edge"] - mean["inner"], F.lit(0.0)))
    return out.select("img_id", v.alias("blockiness"))


# ---- G9 ---------------------------------------------------------------------------------------------------

def _box(t: DataFrame, names, r: int, along: str) -> DataFrame:
    """Box mean of radius r along one axis; beyond the image's edge the edge repeats."""
    win, size = (_line(), "width") if along == "x" else (_column(), "height")
    whole = win.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.greatest(F.lit(r) - F.col(along), F.lit(0))
    after = F.greatest(F.col(along) + r - (F.col(size) - 1), F.lit(0))
    return t.withColumns({c: (F.sum(c).over(win.rowsBetween(-r, r)) + before * F.first(c).over(whole) + after * F.last(c).over(whole))
                          / float(2 * r + 1) for c in names})


def smooth(t: DataFrame, r: int = 3, eps: float = 0.01) -> DataFrame:
    """G9 on a tiled table; reaches 2r pixels. Rows with a false ``_smooth`` (if there is such a column) keep their values."""
    e = eps * 255.0 * 255.0
    t = t.withColumns({n: v.cast("double") for c in CH[:3] for n, v in ((f"_m{c}", F.col(c)), (f"_q{c}", F.col(c) * F.col(c)))})
    names = [f"_{k}{c}" for k in "mq" for c in CH[:3]]
    t = _box(_box(t, names, r, "x"), names, r, "y")
    spread = {c: F.greatest(F.col(f"_q{c}") - F.col(f"_m{c}") * F.col(f"_m{c}"), F.lit(0.0)) for c in CH[:3]}
    t = t.withColumns({f"_q{c}": v / (v + e) for c, v in spread.items()})  # slope
    t = t.withColumns({f"_m{c}": F.col(f"_m{c}") - F.col(f"_q{c}") * F.col(f"_m{c}") for c in CH[:3]})  # offset
    t = _box(_box(t, names, r, "x"), names, r, "y")
    stays = _tiny(2 * r + 2)
    if "_smooth" in t.columns:
        stays = stays | ~F.col("_smooth")
    return t.withColumns({c: F.when(stays, F.col(c)).otherwise(clamp_byte(rounded(F.col(f"_q{c}") * F.col(c) + F.col(f"_m{c}")))).cast("int")
                          for c in CH[:3]}).drop(*names)


def guided_smooth(pixels: DataFrame, r: int = 3, eps: float = 0.01, tile: int = TILE) -> DataFrame:
    """Self-guided edge-preserving smoothing of the colour channels; images smaller than 2r + 2 stay."""
    return cropped(smooth(tiled(pixels, 2 * r, tile), r, eps), tile).select(*PIXEL)
