"""G1-G17 on pixel tables made of the embeddings (8 x 8 images, or 64-column mosaics)."""
from pyspark.sql import functions as F

from assetlake.functions import sizes
from assetlake.operators import grid as G

from assetlake.registry.core import query

CH = ("r", "g", "b", "a")


def each(template, sep=", ", ch=CH):
    """SQL list with {c} replaced by every channel."""
    return sep.join(template.replace("{c}", c) for c in ch)


@query("G1_pixel_profile", """
SELECT img_id, bool_and(a = 255) AS flat_alpha, bool_and(r = g AND g = b) AS gray,
  count(*) FILTER (WHERE a BETWEEN 120 AND 136) / count(*) > 0.95 AS placeholder_alpha,
  count(*) FILTER (WHERE a < 250 AND pow((x + 0.5::DOUBLE) / 8 * 2 - 1, 2) + pow((y + 0.5::DOUBLE) / 8 * 2 - 1, 2) <= 1.0) / count(*) <= 0.005 AS circle_only
FROM V_pixels GROUP BY 1""")
def g1(v):
    return G.pixel_profile(v.px)


@query("G1_pixel_profile_early_exit", """
WITH s AS (SELECT *, max((a <> 255)::INT) OVER w AS o, max((NOT (r = g AND g = b))::INT) OVER w AS c,
  sum((a BETWEEN 120 AND 136)::INT) OVER w AS m, count(*) OVER w AS n FROM V_pixels
  WINDOW w AS (PARTITION BY img_id ORDER BY y, x ROWS UNBOUNDED PRECEDING)),
p AS (SELECT img_id, bool_or(o = 1 AND c = 1 AND m * 20 > n) AS stop, count(*) FILTER (WHERE a BETWEEN 120 AND 136) / count(*) > 0.95 AS ph,
  count(*) FILTER (WHERE a < 250 AND pow((x + 0.5::DOUBLE) / 8 * 2 - 1, 2) + pow((y + 0.5::DOUBLE) / 8 * 2 - 1, 2) <= 1.0) / count(*) <= 0.005 AS co FROM s GROUP BY 1)
SELECT img_id, stop OR ph AS placeholder_alpha, NOT stop AND co AS circle_only FROM p""")
def g1b(v):
    return G.pixel_profile(v.px, compat_early_exit=True).select("img_id", "placeholder_alpha", "circle_only")


_BLOCKS = """blocks AS (SELECT img_id, (y // 2)::INT AS y, (x // 2)::INT AS x, count(*) AS n, """ + each(
    "sum({c}) AS s{c}, sum({c} * a) AS w{c}") + """, list((77 * r + 151 * g + 28 * b) >> 8) AS l FROM V_pixels GROUP BY 1, 2, 3)"""
_MEANS = {c: (f"(s{c} + n // 2) // n" if c == "a" else
              f"CASE WHEN sa < n * 255 THEN CASE WHEN sa > 0 THEN (w{c} + sa // 2) // sa ELSE 0 END ELSE (s{c} + n // 2) // n END")
          for c in CH}


@query("G2_block_mean", f"WITH {_BLOCKS} SELECT img_id, y, x, {each('CAST((s{c} + n // 2) // n AS INT) AS {c}')} FROM blocks")
def g2(v):
    return G.block_mean(v.px, 2, 2)


@query("G2_block_mean_premul", f"WITH {_BLOCKS} SELECT img_id, y, x, {', '.join(f'CAST({e} AS INT) AS {c}' for c, e in _MEANS.items())} FROM blocks")
def g2b(v):
    return G.block_mean(v.px, 2, 2, premul=True)


@query("G3_block_mean_structured", f"""
WITH {_BLOCKS}, m AS (SELECT *, (list_sum(l) + n // 2) // n AS ml FROM blocks),
k AS (SELECT *, len(list_filter(l, lambda e: e < ml)) AS nlo, len(list_filter(l, lambda e: e > ml)) AS nhi FROM m),
d AS (SELECT *, CAST(round_even(round(CASE WHEN nlo <= nhi THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END
  * greatest(0.8::DOUBLE * (1.0 - 2.0 * (least(nlo, nhi) / n)), 0.0) * CASE WHEN nlo <= nhi THEN ml - list_min(l) ELSE list_max(l) - ml END, 6), 0) AS INT) AS delta FROM k)
SELECT img_id, y, x, {each('CAST(greatest(least((s{c} + n // 2) // n + delta, 255), 0) AS INT) AS {c}', ch=CH[:3])},
  CAST((sa + n // 2) // n AS INT) AS a FROM d""")
def g3(v):
    return G.block_mean_structured(v.px, 2, 2, gamma=0.8)


def _resampled(weights, src_cols, pre="", post="{c}"):
    return f"""wt AS ({weights}),
h AS (SELECT img_id, y, d AS x, {each('sum(' + src_cols + ' * w) AS {c}')} FROM V_pixels JOIN wt ON wt.i = V_pixels.x GROUP BY 1, 2, 3),
p AS (SELECT img_id, d AS y, x, {each('sum({c} * w) AS {c}')} FROM h JOIN wt ON wt.i = h.y GROUP BY 1, 2, 3)"""


_BYTE = "CAST(greatest(least(floor(round({v}, 6) + 0.5), 255), 0) AS INT)"
_W_AREA = """SELECT d, i, (least((d + 1) * s, i + 1) - greatest(d * s, i)) / s AS w FROM (
  SELECT unnest(range(3))::INT AS d, 8.0::DOUBLE / 3 AS s), range(8) t(i) WHERE least((d + 1) * s, i + 1) > greatest(d * s, i)"""


@query("G4_area_resample", f"""WITH {_resampled(_W_AREA, '{c}')}
SELECT img_id, y, x, {each(_BYTE.replace('{v}', '{c}') + ' AS {c}')} FROM p""")
def g4(v):
    return G.area_resample(v.px, 3, 3)


@query("G4_area_resample_premul", f"""
WITH wt AS ({_W_AREA}),
h AS (SELECT img_id, y, d AS x, {each('sum({c} * a * w) AS {c}', ch=CH[:3])}, sum(a * w) AS a FROM V_pixels JOIN wt ON wt.i = V_pixels.x GROUP BY 1, 2, 3),
p AS (SELECT img_id, d AS y, x, {each('sum({c} * w) AS {c}')} FROM h JOIN wt ON wt.i = h.y GROUP BY 1, 2, 3)
SELECT img_id, y, x, {each(_BYTE.replace('{v}', '(CASE WHEN a > 0.5 THEN {c} / a ELSE {c} END)') + ' AS {c}', ch=CH[:3])},
  {_BYTE.replace('{v}', 'a')} AS a FROM p""")
def g4b(v):
    return G.area_resample(v.px, 3, 3, premul=True)


def _w_kernel(value, radius):
    return f"""SELECT d, i, sum(k) / max(t) AS w FROM (SELECT d, greatest(least(j, 7), 0) AS i, k, sum(k) OVER (PARTITION BY d) AS t FROM (
    SELECT d, j, {value} AS k FROM (SELECT d, j, abs(j - c) AS a FROM (SELECT unnest(range(12))::INT AS d), range(-9, 18) t(j),
      (SELECT 8.0::DOUBLE / 12 AS s) , LATERAL (SELECT (d + 0.5::DOUBLE) * s - 0.5 AS c))
    WHERE a < {radius}) WHERE k <> 0) GROUP BY d, i"""


_LANCZOS3 = "CASE WHEN a < 1e-9 THEN 1.0 ELSE sin(pi() * a) / (pi() * a) * sin(pi() * a / 3) / (pi() * a / 3) END"
_CATMULL = "CASE WHEN a < 1 THEN 1.5 * a * a * a - 2.5 * a * a + 1 ELSE -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2 END"
_MITCHELL = ("CASE WHEN a < 1 THEN (7 * a * a * a - 12 * a * a + 16.0 / 3) / 6 ELSE "
             "(-7.0 / 3 * a * a * a + 12 * a * a - 20 * a + 32.0 / 3) / 6 END")
_KERNELS = {"lanczos3": (_LANCZOS3, 3.0),
            "lanczos2": (_LANCZOS3.replace("/ 3", "/ 2"), 2.0), "catmull": (_CATMULL, 2.0), "mitchell": (_MITCHELL, 2.0),
            "bilinear": ("1 - a", 1.0)}


def _register_kernel(kernel, value, radius):
    @query(f"G5_kernel_upscale_{kernel}", f"""WITH {_resampled(_w_kernel(value, radius), '{c}')}
SELECT img_id, y, x, {each(_BYTE.replace('{v}', '{c}') + ' AS {c}')} FROM p""")
    def g5(v):
        return G.kernel_upscale(v.px, 12, 12, kernel)


for _k, (_v, _r) in _KERNELS.items():
    _register_kernel(_k, _v, _r)


@query("G5_kernel_upscale_nearest", f"""
SELECT img_id, ty AS y, tx AS x, {each('{c}')} FROM V_pixels JOIN range(16) u(ty) ON ty // 2 = y JOIN range(16) w(tx) ON tx // 2 = x""")
def g5n(v):
    out = G.kernel_upscale(v.px, 16, 16, "nearest")
    return out.withColumns({c: F.col(c).cast("long") for c in ("y", "x")})


# neighbours with clamped edges for the 8 x 8 images
def _nb(table, cols):
    def join(dy, dx, name):
        return (f"JOIN {table} {name} ON {name}.img_id = c.img_id AND {name}.y = greatest(least(c.y + {dy}, 7), 0) "
                f"AND {name}.x = greatest(least(c.x + {dx}, 7), 0)")
    names = [(dy, dx, "n" + "mzp"[dy + 1] + "mzp"[dx + 1]) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return f"{table} c " + " ".join(join(*n) for n in names)


def _blur(col):
    parts = [f"{(2 - abs(dy)) * (2 - abs(dx))} * n{'mzp'[dy + 1]}{'mzp'[dx + 1]}.{col}" for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return f"(({' + '.join(parts)} + 8) >> 4)"


@query("G6_unsharp", f"""
SELECT c.img_id, c.y, c.x, {each("CAST(greatest(least(round_even(round(c.{c} + 0.6::DOUBLE * (c.{c} - " + _blur('{c}') + "), 6), 0), 255), 0) AS INT) AS {c}", ch=CH[:3])},
  c.a FROM {_nb('V_pixels', CH)}""")
def g6(v):
    return G.unsharp(v.px, 0.6).drop("width", "height")


_LUM = """lum AS (SELECT *, (77 * r + 151 * g + 28 * b) >> 8 AS l FROM V_pixels)"""
_GRAD = f"""grad AS (SELECT c.*, pow(nmp.l - nmm.l + 2 * (nzp.l - nzm.l) + npp.l - npm.l, 2)
  + pow(npm.l - nmm.l + 2 * (npz.l - nmz.l) + npp.l - nmp.l, 2) AS g2, {each(_blur('{c}') + ' AS b{c}')}
  FROM {_nb('lum', CH)})"""
_P95 = """hist AS (SELECT img_id, least(CAST(floor(sqrt(g2)) AS INT) >> 2, 255) AS k, count(*) AS n FROM grad GROUP BY ALL),
run AS (SELECT img_id, k, sum(CASE WHEN k >= 1 THEN n ELSE 0 END) OVER (PARTITION BY img_id ORDER BY k) AS acc,
  CAST(floor(sum(n) OVER (PARTITION BY img_id) * 0.95) AS BIGINT) AS want FROM hist),
ref AS (SELECT img_id, greatest(coalesce(min(k) FILTER (WHERE k >= 1 AND acc >= want), 256), 4) AS ref FROM run GROUP BY 1)"""


@query("G6_unsharp_edge_aware", f"""
WITH {_LUM}, {_GRAD}, {_P95}
SELECT img_id, y, x, {each("CAST(greatest(least(round_even(round({c} + (0.6::DOUBLE + 1.9::DOUBLE * least(sqrt(g2) / 4.0 / ref, 1.0)) * ({c} - b{c}), 6), 0), 255), 0) AS INT) AS {c}")}
FROM grad JOIN ref USING (img_id)""")
def g6b(v):
    return G.unsharp(v.px, 0.6, k_edge=2.5, alpha=True).drop("width", "height")


@query("G6_unsharp_premul", f"""
WITH pre AS (SELECT *, {each('CASE WHEN a = 255 THEN {c} ELSE {c} * a // 255 END AS p{c}', ch=CH[:3])} FROM V_pixels)
SELECT c.img_id, c.y, c.x, {each("CASE WHEN c.a < 32 THEN c.{c} ELSE CAST(greatest(least(round_even(round(round_even(round(c.p{c} + 0.6::DOUBLE * (c.p{c} - " + _blur('p{c}') + "), 6), 0) * 255.0::DOUBLE / c.a, 6), 0), 255), 0) AS INT) END AS {c}", ch=CH[:3])},
  c.a FROM {_nb('pre', CH)}""")
def g6c(v):
    return G.unsharp(v.px, 0.6, premul=True).drop("width", "height")


def _cas(c, peak):
    vals = [f"nmp.{c}", f"nzp.{c}", f"npp.{c}", f"nzm.{c}", f"c.{c}"]
    mn, mx = f"least({', '.join(vals)})", f"greatest({', '.join(vals)})"
    amp = f"sqrt(greatest(least(least({mn}, 255.0::DOUBLE - {mx}), {mx}) / greatest({mx}, 1)::DOUBLE, 0.0))"
    w = f"({amp} * {peak}::DOUBLE)"
    val = f"(({' + '.join(vals[:4])}) * {w} + c.{c}) / (4.0 * {w} + 1.0)"
    return f"CASE WHEN {mx} = 0 THEN c.{c} ELSE CAST(greatest(least(round_even(round({val}, 6), 0), 255), 0) AS INT) END AS {c}"


@query("G7_cas", f"SELECT c.img_id, c.y, c.x, {', '.join(_cas(c, repr(-1.0 / (8.0 - 3.0 * 0.6))) for c in CH[:3])}, c.a FROM {_nb('V_pixels', CH)}")
def g7(v):
    return G.cas(v.px, 1.5).drop("width", "height")


@query("G8_blockiness", """
WITH d AS (SELECT img_id, y, x, abs(v - lag(v) OVER (PARTITION BY img_id, y ORDER BY x)) AS dh,
  ((v * 256) >> ((8 - 256 * lag(v) OVER (PARTITION BY img_id, x ORDER BY y)) & 31)) >> 8 AS dv, max(y) OVER (PARTITION BY img_id) + 1 AS h FROM V_mosaic),
s AS (SELECT img_id, h, dh AS e, x % 8 = 0 AS edge FROM d WHERE y >= 4 AND x >= 8 AND x % 8 = 0 UNION ALL
  SELECT img_id, h, dh, false FROM d WHERE y >= 4 AND x >= 12 AND x % 8 = 4 UNION ALL
  SELECT img_id, h, dv, true FROM d WHERE x >= 4 AND y >= 8 AND y % 8 = 0 UNION ALL
  SELECT img_id, h, dv, false FROM d WHERE x >= 4 AND y >= 12 AND y % 8 = 4)
SELECT img_id, round(CASE WHEN max(h) < 32 THEN 0.0 ELSE avg(e) FILTER (WHERE edge) - avg(e) FILTER (WHERE NOT edge) END, 6) AS blockiness
FROM s GROUP BY 1""")
def g8(v):
    return G.blockiness(v.mosaic).withColumn("blockiness", F.round("blockiness", 6))


@query("G8_blockiness_luminance", """
WITH d AS (SELECT img_id, y, x, abs(v - lag(v) OVER (PARTITION BY img_id, y ORDER BY x)) AS dh,
  abs(v - lag(v) OVER (PARTITION BY img_id, x ORDER BY y)) AS dv, max(y) OVER (PARTITION BY img_id) + 1 AS h FROM V_mosaic),
s AS (SELECT img_id, h, dh AS e, x % 8 = 0 AS edge FROM d WHERE y >= 4 AND x >= 8 AND (y - 4) % 2 = 0 AND x % 8 = 0 UNION ALL
  SELECT img_id, h, dh, false FROM d WHERE y >= 4 AND x >= 12 AND (y - 4) % 2 = 0 AND x % 8 = 4 UNION ALL
  SELECT img_id, h, dv, true FROM d WHERE x >= 4 AND y >= 8 AND (x - 4) % 3 = 0 AND y % 8 = 0 UNION ALL
  SELECT img_id, h, dv, false FROM d WHERE x >= 4 AND y >= 12 AND (x - 4) % 3 = 0 AND y % 8 = 4)
SELECT img_id, round(CASE WHEN max(h) < 32 THEN 0.0 ELSE avg(e) FILTER (WHERE edge) - avg(e) FILTER (WHERE NOT edge) END, 6) AS blockiness
FROM s GROUP BY 1""")
def g8_luminance(v):
    """Luminance in both halves, every second row and third column."""
    return G.blockiness(v.mosaic, 2, 3, compat_shift=False).withColumn("blockiness", F.round("blockiness", 6))


def _box2(name, table, cols):
    def axis(src, vary, hold):
        return (f"SELECT c.img_id, c.y, c.x, {', '.join(f'sum(s.{n}) / 3.0::DOUBLE AS {n}' for n in cols)} FROM {src} c CROSS JOIN taps "
                f"JOIN {src} s ON s.img_id = c.img_id AND s.{hold} = c.{hold} AND s.{vary} = greatest(least(c.{vary} + taps.k, 7), 0) GROUP BY 1, 2, 3")
    return f"{name}_h AS ({axis(table, 'x', 'y')}), {name} AS ({axis(name + '_h', 'y', 'x')})"


_E = repr(0.01 * 255.0 * 255.0)


@query("G9_guided_smooth", f"""
WITH taps AS (SELECT unnest(range(-1, 2)) AS k), src AS (SELECT *, {each('{c}::DOUBLE AS m{c}, ({c} * {c})::DOUBLE AS q{c}', ch=CH[:3])} FROM V_pixels),
{_box2('b1', 'src', ['m' + c for c in CH[:3]] + ['q' + c for c in CH[:3]])},
ab AS (SELECT *, {each('m{c} - a{c} * m{c} AS b{c}', ch=CH[:3])} FROM (SELECT *, {each(f'greatest(q{{c}} - m{{c}} * m{{c}}, 0) / (greatest(q{{c}} - m{{c}} * m{{c}}, 0) + {_E}::DOUBLE) AS a{{c}}', ch=CH[:3])} FROM b1)),
{_box2('b2', 'ab', ['a' + c for c in CH[:3]] + ['b' + c for c in CH[:3]])}
SELECT p.img_id, p.y, p.x, {each('CAST(greatest(least(round_even(round(a{c} * {c} + b{c}, 6), 0), 255), 0) AS INT) AS {c}', ch=CH[:3]).replace('a{c}', 'a{c}')}, p.a
FROM (SELECT img_id, y, x, r AS r_, g AS g_, b AS b_, a FROM V_pixels) p JOIN b2 USING (img_id, y, x)""".replace(
    "round(ar * r + br", "round(ar * r_ + br").replace("round(ag * g + bg", "round(ag * g_ + bg").replace("round(ab * b + bb", "round(ab * b_ + bb"))
def g9(v):
    return G.guided_smooth(v.px, r=1).drop("width", "height")


# G6, G7, G9 on one image of all vectors, in tiles of 256 pixels: neighbours by windows along lines and columns
def _around(cols, table="V_canvas", by=""):
    row = each("coalesce(lag({c}) OVER r, {c}) AS l{c}, coalesce(lead({c}) OVER r, {c}) AS q{c}", ch=cols)
    names = [p + c for p in ("", "l", "q") for c in cols]
    col = each("coalesce(lag({c}) OVER k, {c}) AS u{c}, coalesce(lead({c}) OVER k, {c}) AS d{c}", ch=names)
    return f"""rows_ AS MATERIALIZED (SELECT *, {row} FROM {table} WINDOW r AS (PARTITION BY {by}y ORDER BY x)),
around AS MATERIALIZED (SELECT *, {col} FROM rows_ WINDOW k AS (PARTITION BY {by}x ORDER BY y))"""


def _blur9(c):
    return f"((ul{c} + 2 * u{c} + uq{c} + 2 * (l{c} + 2 * {c} + q{c}) + dl{c} + 2 * d{c} + dq{c} + 8) >> 4)"


_CANVAS_LUM = """lum AS (SELECT *, (77 * r + 151 * g + 28 * b) >> 8 AS l FROM V_canvas)"""
_CANVAS_REF = """grad AS MATERIALIZED (SELECT *, sqrt(pow(uql - ull + 2 * (ql - ll) + dql - dll, 2) + pow(dll - ull + 2 * (dl - ul) + dql - uql, 2)) AS gr FROM around),
hist AS (SELECT least(CAST(floor(gr) AS INT) >> 2, 255) AS k, count(*) AS n FROM grad GROUP BY ALL),
run AS (SELECT k, sum(CASE WHEN k >= 1 THEN n ELSE 0 END) OVER (ORDER BY k) AS acc, CAST(floor(sum(n) OVER () * 0.95) AS BIGINT) AS want FROM hist),
ref AS (SELECT greatest(coalesce(min(k) FILTER (WHERE k >= 1 AND acc >= want), 256), 4) AS ref FROM run)"""


@query("G6_unsharp_canvas", f"""
WITH {_CANVAS_LUM}, {_around(["r", "g", "b", "l"], "lum")}, {_CANVAS_REF}
SELECT y, x, {each("CAST(greatest(least(round_even(round({c} + (0.6::DOUBLE + 1.9::DOUBLE * least(gr / 4.0 / ref, 1.0)) * ({c} - " + _blur9('{c}') + "), 6), 0), 255), 0) AS INT) AS {c}", ch=CH[:3])}, a
FROM grad, ref""")
def g6_canvas(v):
    return G.unsharp(v.canvas, 0.6, k_edge=2.5).drop("img_id", "width", "height")


def _cas_window(c, peak):
    vals = [f"uq{c}", f"q{c}", f"dq{c}", f"l{c}", c]
    mn, mx = f"least({', '.join(vals)})", f"greatest({', '.join(vals)})"
    w = f"(sqrt(least({mn}, 255.0::DOUBLE - {mx}) / greatest({mx}, 1)::DOUBLE) * {peak}::DOUBLE)"
    return (f"CASE WHEN {mx} = 0 THEN {c} ELSE CAST(greatest(least(round_even(round((({' + '.join(vals[:4])}) * {w} + {c}) / (4.0 * {w} + 1.0), 6), 0), 255), 0) "
            f"AS INT) END AS {c}")


@query("G7_cas_canvas", f"WITH {_around(CH)} SELECT y, x, {', '.join(_cas_window(c, repr(-1.0 / (8.0 - 3.0 * 0.6))) for c in CH)} FROM around")
def g7_canvas(v):
    return G.cas(v.canvas, 1.5, alpha=True).drop("img_id", "width", "height")


def _box_window(name, table, cols, r=3, by="", last="max({pos}) OVER ()"):
    """Box means by windows, the edge repeated by weights."""
    def axis(src, pos, hold):
        edge = (f"greatest({r} - {pos}, 0) * first_value({{c}}) OVER (PARTITION BY {by}{hold} ORDER BY {pos} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + "
                f"greatest({pos} + {r} - {last.replace('{pos}', pos)}, 0) * last_value({{c}}) OVER (PARTITION BY {by}{hold} ORDER BY {pos} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
        frame = f"sum({{c}}) OVER (PARTITION BY {by}{hold} ORDER BY {pos} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
        return f"SELECT * REPLACE ({each(f'(({frame} + {edge}) / {2 * r + 1}.0::DOUBLE) AS {{c}}', ch=cols)}) FROM {src}"
    return f"{name}_h AS MATERIALIZED ({axis(table, 'x', 'y')}), {name} AS MATERIALIZED ({axis(name + '_h', 'y', 'x')})"


@query("G9_guided_smooth_canvas", f"""
WITH src AS (SELECT *, {each('{c}::DOUBLE AS m{c}, ({c} * {c})::DOUBLE AS q{c}', ch=CH[:3])} FROM V_canvas),
{_box_window('b1', 'src', ['m' + c for c in CH[:3]] + ['q' + c for c in CH[:3]])},
s AS (SELECT * REPLACE ({each(f'(greatest(q{{c}} - m{{c}} * m{{c}}, 0) / (greatest(q{{c}} - m{{c}} * m{{c}}, 0) + {_E}::DOUBLE)) AS q{{c}}', ch=CH[:3])}) FROM b1),
o AS (SELECT * REPLACE ({each('(m{c} - q{c} * m{c}) AS m{c}', ch=CH[:3])}) FROM s),
{_box_window('b2', 'o', ['m' + c for c in CH[:3]] + ['q' + c for c in CH[:3]])}
SELECT y, x, {each('CAST(greatest(least(round_even(round(q{c} * {c} + m{c}, 6), 0), 255), 0) AS INT) AS {c}', ch=CH[:3])}, a FROM b2""")
def g9_canvas(v):
    return G.guided_smooth(v.canvas).drop("img_id", "width", "height")


@query("G3_block_mean_one_block", """
WITH s AS (SELECT count(*) AS n, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb, sum(a) AS sa, sum((77 * r + 151 * g + 28 * b) >> 8) AS sl FROM V_canvas),
m AS (SELECT *, (sl + n // 2) // n AS ml FROM s),
k AS (SELECT any_value(m.n) AS n, any_value(sr) AS sr, any_value(sg) AS sg, any_value(sb) AS sb, any_value(sa) AS sa, any_value(ml) AS ml,
  count(*) FILTER (WHERE l < ml) AS lo, count(*) FILTER (WHERE l > ml) AS hi, min(l) AS mi, max(l) AS ma FROM (SELECT (77 * r + 151 * g + 28 * b) >> 8 AS l FROM V_canvas), m),
d AS (SELECT *, CAST(round_even(round(0.8::DOUBLE * greatest(1.0 - 2.0 * (least(lo, hi) / n), 0.0) * (CASE WHEN lo <= hi THEN mi ELSE ma END - ml), 6), 0) AS INT) AS p FROM k)
SELECT 0 AS y, 0 AS x, CAST(greatest(least((sr + n // 2) // n + p, 255), 0) AS INT) AS r, CAST(greatest(least((sg + n // 2) // n + p, 255), 0) AS INT) AS g,
  CAST(greatest(least((sb + n // 2) // n + p, 255), 0) AS INT) AS b, CAST((sa + n // 2) // n AS INT) AS a FROM d""")
def g3_one_block(v):
    """The whole canvas as one block."""
    return G.block_mean_structured(v.canvas, F.col("width"), F.col("height"), gamma=0.8).drop("img_id")


@query("G10_rgbe", """
SELECT img_id, y, x, round(r * pow(2.0, e - 136), 9) AS linear, CASE WHEN m = 0 THEN 0 ELSE ex + 128 END AS e_back,
  CAST(CASE WHEN m = 0 THEN 0 ELSE floor(r * pow(2.0, e - 136) * 256 / pow(2.0, ex)) END AS INT) AS r_back FROM (
  SELECT *, CASE WHEN m > 0 THEN CAST(floor(log2(m * pow(2.0, e - 136))) AS INT) + 1 END AS ex FROM (
    SELECT *, greatest(r, g, b) AS m, 120 + a % 16 AS e FROM (SELECT img_id, y, x, a,
      CASE WHEN x = 3 THEN 0 ELSE r END AS r, CASE WHEN x = 3 THEN 0 ELSE g END AS g, CASE WHEN x = 3 THEN 0 ELSE b END AS b FROM V_pixels)))""")
def g10(v):
    e = F.lit(120) + F.col("a") % 16
    lin = [sizes.rgbe_to_linear(F.col(c), e).alias("l" + c) for c in CH[:3]]
    black = v.px.withColumns({c: F.when(F.col("x") == 3, 0).otherwise(F.col(c)) for c in CH[:3]})
    d = black.select("img_id", "y", "x", *lin)
    back = sizes.linear_to_rgbe(*[F.col("l" + c) for c in CH[:3]])
    return d.select("img_id", "y", "x", F.round("lr", 9).alias("linear"), back["e"].alias("e_back"), back["r"].alias("r_back"))


@query("G11_box_resize", """
WITH b AS (SELECT d, CAST(floor(d * s) AS INT) AS lo, least(8, greatest(CAST(floor(d * s) AS INT) + 1, CAST(floor((d + 1) * s) AS INT))) AS hi
  FROM (SELECT unnest(range(3))::INT AS d, 8.0::DOUBLE / 3 AS s))
SELECT img_id, by_.d AS y, bx.d AS x, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM V_pixels
JOIN b by_ ON y >= by_.lo AND y < by_.hi JOIN b bx ON x >= bx.lo AND x < bx.hi GROUP BY 1, 2, 3""")
def g11(v):
    out = G.box_resize(v.px, 3, 3)
    return out.withColumns({c: F.round(c, 6) for c in CH[:3]})


@query("G12_tone_map", """
SELECT img_id, y, x, CAST(greatest(least(floor(pow(t / (t + 1.0), 1.0 / 2.2) * 255.0 + 0.5), 255), 0) AS INT) AS shown FROM (
  SELECT img_id, y, x, greatest((v - 100) / 40.0::DOUBLE, 0.0) AS t FROM V_grid)""")
def g12(v):
    return v.grid.select("img_id", "y", "x", sizes.tone_map((F.col("v") - 100) / F.lit(40.0)).alias("shown"))


@query("G13_grid_stats", """
SELECT img_id, CAST(sum(r) AS BIGINT) AS r_sum, round(avg(r), 6) AS r_mean, min(r) AS r_min, max(r) AS r_max FROM V_pixels GROUP BY 1""")
def g13(v):
    return G.grid_stats(v.px).withColumn("r_mean", F.round("r_mean", 6))


@query("G13_grid_diff", """
SELECT img_id, CAST(sum((p.r <> q.r)::INT + (p.g <> q.g)::INT + (p.b <> q.b)::INT + (p.a <> q.a)::INT) AS BIGINT) AS n_diff FROM V_pixels p
JOIN (SELECT img_id, y, x, greatest(r, g) AS r, g, least(b, 120) AS b, a FROM V_pixels) q USING (img_id, y, x) GROUP BY 1""")
def g13b(v):
    other = v.px.select("img_id", "y", "x", F.greatest("r", "g").alias("r"), "g", F.least("b", F.lit(120)).alias("b"), "a")
    return G.grid_diff(v.px, other)


_PRED = {0: "0", 1: "l", 2: "u", 3: "(l + u) >> 1",
         4: ("CASE WHEN abs(u - d) <= abs(l - d) AND abs(u - d) <= abs(l + u - 2 * d) THEN l "
             "WHEN abs(l - d) <= abs(l + u - 2 * d) THEN u ELSE d END")}


@query("G14_predictor_choice", f"""
WITH ch AS (SELECT img_id, y, x, unnest(['r', 'g', 'b', 'a']) AS c, unnest([r, g, b, a]) AS v FROM V_pixels),
nb AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY img_id, c, y ORDER BY x), 0) AS l,
  coalesce(lag(v) OVER (PARTITION BY img_id, c, x ORDER BY y), 0) AS u FROM ch),
nd AS (SELECT *, coalesce(lag(u) OVER (PARTITION BY img_id, c, y ORDER BY x), 0) AS d FROM nb),
sc AS ({' UNION ALL '.join(f"SELECT img_id, y, {f} AS f, sum(least((v - ({p})) & 255, 256 - ((v - ({p})) & 255))) AS score FROM nd GROUP BY 1, 2" for f, p in _PRED.items())})
SELECT img_id, y, min_by(f, (score, f)) AS predictor, CAST(min(score) AS BIGINT) AS score FROM sc GROUP BY 1, 2""")
def g14(v):
    return G.predictor_choice(v.px)


@query("G15_gray_candidates", """
SELECT img_id, NOT bool_and(a = 255) AS with_alpha, count(*) * 2 AS saved_bytes FROM V_pixels GROUP BY 1 HAVING bool_and(r = g AND g = b)""")
def g15(v):
    return G.gray_candidates(v.px)


_SYMBOLS = "SELECT source, s FROM (SELECT source, unnest(string_split(text, '')) AS s FROM documents)"


@query("G16_symbol_histogram", f"SELECT source, s, count(*) AS n FROM ({_SYMBOLS}) GROUP BY ALL")
def g16(v):
    return G.symbol_histogram(_symbols(v), ["source"], "s")


@query("G16_entropy_bytes", f"""
SELECT source, CAST(sum(n) AS BIGINT) AS n_symbols, count(*) AS n_distinct,
  round((sum(n)::DOUBLE * log2(sum(n)::DOUBLE) - sum(n::DOUBLE * log2(n::DOUBLE))) / 8.0, 3) AS entropy_bytes
FROM (SELECT source, s, count(*) AS n FROM ({_SYMBOLS}) GROUP BY ALL) GROUP BY 1""")
def g16b(v):
    out = G.entropy_bytes(G.symbol_histogram(_symbols(v), ["source"], "s"), ["source"])
    return out.withColumn("entropy_bytes", F.round("entropy_bytes", 3))


def _symbols(v):
    return v.documents.select("source", F.explode(F.split("text", "")).alias("s"))


# Images keep their size, halve it, shrink to 3 x 3 or grow to 12 x 12, by label; gray opaque ones can be packed
def _g17_resized(value, rounded, blocks):
    """CTEs up to ``changed``: the resized images with their edge n. value: what the passes add up; rounded: a channel."""
    def passes(name, weights, n):
        return (f"h{name} AS MATERIALIZED (SELECT img_id, y, d AS x, {value} FROM V_pixels JOIN {weights} ON {weights}.i = V_pixels.x WHERE label % 4 = {n} GROUP BY 1, 2, 3), "
                f"p{name} AS MATERIALIZED (SELECT img_id, d AS y, x, {each('sum({c} * w) AS {c}')} FROM h{name} JOIN {weights} ON {weights}.i = h{name}.y GROUP BY 1, 2, 3)")
    return f"""{_BLOCKS}, lab AS MATERIALIZED (SELECT img_id, any_value(label) AS label, bool_and(r = g AND g = b AND a = 255) AS pack FROM V_pixels GROUP BY 1),
wa AS MATERIALIZED ({_W_AREA}), wk AS MATERIALIZED ({_w_kernel(_LANCZOS3, 3.0)}), {passes('a', 'wa', 2)}, {passes('k', 'wk', 3)},
changed AS MATERIALIZED (SELECT img_id, y::INT AS y, x::INT AS x, {blocks}, 4 AS n FROM blocks JOIN lab USING (img_id) WHERE label % 4 = 1 UNION ALL
  SELECT img_id, y::INT, x::INT, {rounded}, 3 FROM pa UNION ALL SELECT img_id, y::INT, x::INT, {rounded}, 12 FROM pk)"""


_G17_OUT = """SELECT img_id, y, x, r, g, b, a, n AS width, n AS height, CASE WHEN pack THEN b END AS gray FROM (
  SELECT img_id, y, x, r, g, b, a, 8 AS n FROM V_pixels WHERE label % 4 = 0 UNION ALL SELECT img_id, y, x, r, g, b, a, n FROM sharp) JOIN lab USING (img_id)"""


@query("G17_process_grid", f"""
WITH {_g17_resized(each('sum({c} * w) AS {c}'), each(_BYTE.replace('{v}', '{c}')), each('CAST((s{c} + n // 2) // n AS INT) AS {c}'))},
{_around(CH, "changed", "img_id, ")},
sharp AS (SELECT img_id, y, x, {', '.join(_cas_window(c, repr(-1.0 / (8.0 - 3.0 * 0.6))) for c in CH)}, n FROM around) {_G17_OUT}""")
def g17(v):
    """Alpha is sharpened like a colour."""
    return G.process_grid(v.px, _g17_rules(v), sharpen="cas", strength=1.5, alpha=True)


_SOFT = each(_BYTE.replace("{v}", "(CASE WHEN a > 0.5 THEN {c} / a ELSE {c} END)"), ch=CH[:3]) + ", " + _BYTE.replace("{v}", "a")


@query("G17_process_grid_denoised", f"""
WITH {_g17_resized(each('sum({c} * a * w) AS {c}', ch=CH[:3]) + ', sum(a * w) AS a', _SOFT, ', '.join(f'CAST({e} AS INT) AS {c}' for c, e in _MEANS.items()))},
src AS (SELECT *, {each('{c}::DOUBLE AS m{c}, ({c} * {c})::DOUBLE AS q{c}', ch=CH[:3])} FROM changed),
{_box_window('b1', 'src', ['m' + c for c in CH[:3]] + ['q' + c for c in CH[:3]], 1, "img_id, ", "(n - 1)")},
s AS (SELECT * REPLACE ({each(f'(greatest(q{{c}} - m{{c}} * m{{c}}, 0) / (greatest(q{{c}} - m{{c}} * m{{c}}, 0) + {_E}::DOUBLE)) AS q{{c}}', ch=CH[:3])}) FROM b1),
o AS (SELECT * REPLACE ({each('(m{c} - q{c} * m{c}) AS m{c}', ch=CH[:3])}) FROM s),
{_box_window('b2', 'o', ['m' + c for c in CH[:3]] + ['q' + c for c in CH[:3]], 1, "img_id, ", "(n - 1)")},
soft AS (SELECT img_id, y, x, n, a, {each('CASE WHEN n = 4 THEN CAST(greatest(least(round_even(round(q{c} * {c} + m{c}, 6), 0), 255), 0) AS INT) ELSE {c} END AS {c}', ch=CH[:3])} FROM b2),
pre AS (SELECT *, (77 * pr + 151 * pg + 28 * pb) >> 8 AS l FROM (SELECT *, {each('CASE WHEN a = 255 THEN {c} ELSE {c} * a // 255 END AS p{c}', ch=CH[:3])} FROM soft)),
{_around(["pr", "pg", "pb", "l"], "pre", "img_id, ")},
grad AS MATERIALIZED (SELECT *, sqrt(pow(uql - ull + 2 * (ql - ll) + dql - dll, 2) + pow(dll - ull + 2 * (dl - ul) + dql - uql, 2)) AS gr FROM around),
hist AS (SELECT img_id, least(CAST(floor(gr) AS INT) >> 2, 255) AS k, count(*) AS n FROM grad GROUP BY ALL),
run AS (SELECT img_id, k, sum(CASE WHEN k >= 1 THEN n ELSE 0 END) OVER (PARTITION BY img_id ORDER BY k) AS acc,
  CAST(floor(sum(n) OVER (PARTITION BY img_id) * 0.95) AS BIGINT) AS want FROM hist),
ref AS (SELECT img_id, greatest(coalesce(min(k) FILTER (WHERE k >= 1 AND acc >= want), 256), 4) AS ref FROM run GROUP BY 1),
sharp AS (SELECT img_id, y, x, n, a, {each("CASE WHEN a < 32 THEN {c} ELSE CAST(greatest(least(round_even(round(round_even(round(p{c} + (0.6::DOUBLE + 1.9::DOUBLE * least(gr / 4.0 / ref, 1.0)) * (p{c} - " + _blur9('p{c}') + "), 6), 0) * 255.0::DOUBLE / greatest(a, 1), 6), 0), 255), 0) AS INT) END AS {c}", ch=CH[:3])}
  FROM grad JOIN ref USING (img_id)) {_G17_OUT}""")
def g17b(v):
    return G.process_grid(v.px, _g17_rules(v), denoise="all", sharpen="edge", strength=0.6, k_edge=2.5, premul=True, radius=1)


def _g17_rules(v):
    n = F.col("label") % 4
    size = F.when(n == 0, 8).when(n == 1, 4).when(n == 2, 3).otherwise(12)
    sizes_ = v.embeddings.select(F.col("vec_id").alias("img_id"), size.alias("new_width"), size.alias("new_height"))
    pack = G.pixel_profile(v.px).select("img_id", (F.col("gray") & F.col("flat_alpha")).alias("pack"))
    return sizes_.join(pack, "img_id")
