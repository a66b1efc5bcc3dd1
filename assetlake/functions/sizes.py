"""P15-P18, R6-R8 arithmetic, G10, G12: number columns."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake import fixed as K
from assetlake.functions.classify import is_data_class


def _edge(n: Column, scale: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(n * scale, 0).cast("int"))


def shrink_scale(width: Column, height: Column, cap: Column) -> Column:
    longest = F.greatest(width, height)
    return F.when((cap > 0) & (longest > cap), cap.cast("double") / longest).otherwise(F.lit(1.0))


def target_size(width: Column, height: Column, cap: Column) -> Column:
    """struct(width, height); edges round half to even and never vanish."""
    sc = shrink_scale(width, height, cap)
    return F.struct(_edge(width, sc).alias("width"), _edge(height, sc).alias("height"))


def upscale_plan(cls: Column, width: Column, height: Column, cap: Column, up: Column,
                 ceiling: int = K.UP_CEILING) -> Column:
    """struct(factor, reason). Factor 0 means no upscaling; reason is data, cap or NULL."""
    longest = F.greatest(width, height)
    limit = F.least(cap, F.lit(ceiling))
    wanted = up > 1
    fits = F.when(longest * up <= limit, up).when((up >= 4) & (longest * 2 <= limit), F.lit(2)).otherwise(F.lit(0))
    factor = F.when(wanted & ~is_data_class(cls) & (cap > 0), fits).otherwise(F.lit(0))
    reason = (F.when(~wanted, F.lit(None).cast("string"))
              .when(is_data_class(cls), F.lit("data"))
              .when((cap <= 0) | (factor == 0), F.lit("cap")))
    return F.struct(factor.cast("int").alias("factor"), reason.alias("reason"))


def effective(value: Column, default: Column) -> Column:
    """The asset's own value when it is set, else the global one."""
    return F.coalesce(value, default)


def pct(after: Column, before: Column) -> Column:
    """P18."""
    return F.lit(100.0) * after / F.greatest(before, F.lit(1))


def rgbe_to_linear(mantissa: Column, exponent: Column) -> Column:
    """Byte * 2^(E-136), zero exponent is black."""
    return F.when(exponent == 0, F.lit(0.0)).otherwise(mantissa * F.pow(F.lit(2.0), exponent - 136))


def linear_to_rgbe(r: Column, g: Column, b: Column) -> Column:
    """struct(r, g, b, e); the mantissa of the largest channel lies in [0.5, 1)."""
    top = F.greatest(r, g, b)
    e0 = F.floor(F.log2(top)) + 1
    m0 = top / F.pow(F.lit(2.0), e0)
    e = F.when(m0 >= 1, e0 + 1).when(m0 < 0.5, e0 - 1).otherwise(e0).cast("int")
    scale = (top / F.pow(F.lit(2.0), e)) * 256.0 / top
    lit_ok = top > 1e-32

    def byte(v):
        return F.when(lit_ok, F.greatest(F.least(F.floor(v * scale), F.lit(255)), F.lit(0))).otherwise(0).cast("int")
    ebyte = F.when(lit_ok, F.least(F.greatest(e + 128, F.lit(0)), F.lit(255))).otherwise(0).cast("int")
    return F.struct(byte(r).alias("r"), byte(g).alias("g"), byte(b).alias("b"), ebyte.alias("e"))


def tone_map(v: Column) -> Column:
    """Linear value to an 8-bit display value."""
    pos = F.greatest(v, F.lit(0.0))
    t = pos / (pos + 1.0)
    return F.greatest(F.least(F.floor(F.pow(t, F.lit(1.0 / 2.2)) * 255.0 + 0.5), F.lit(255)), F.lit(0)).cast("int")


def clamp_byte(v: Column) -> Column:
    return F.greatest(F.least(v, F.lit(255)), F.lit(0)).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    wr, wg, wb = K.LUMA
    return F.shiftright(r * wr + g * wg + b * wb, 8)
