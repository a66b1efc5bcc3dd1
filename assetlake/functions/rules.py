"""Rule values: struct columns with NULL for "follow the global setting"."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake import fixed as K
from assetlake.schemas import RULE


def _lit(v, kind):
    return v.cast(kind) if isinstance(v, Column) else F.lit(v).cast(kind)


def rule(fmt="keep", size=0, sharpen_pct=None, sharpen_mode=None, gray_a=None, up=None) -> Column:
    return F.struct(
        _lit(fmt, "string").alias("format"), _lit(size, "int").alias("size"),
        _lit(sharpen_pct, "int").alias("sharpen_pct"), _lit(sharpen_mode, "string").alias("sharpen_mode"),
        _lit(gray_a, "int").alias("gray_a"), _lit(up, "int").alias("up"))


def no_rule() -> Column:
    return F.lit(None).cast(RULE)


def format_rank(fmt: Column) -> Column:
    out = None
    for f, r in K.FORMAT_RANK.items():
        out = F.when(fmt == f, F.lit(r)) if out is None else out.when(fmt == f, F.lit(r))
    return out.otherwise(F.lit(K.UNKNOWN_FORMAT_RANK))


def size_text(size: Column) -> Column:
    return F.when(size > 0, F.concat(F.lit("/"), size.cast("string"))).otherwise(F.lit("/unscaled"))


def rule_text(r: Column) -> Column:
    """Short description: format/size plus sharpening and gray where the rule sets them."""
    return F.concat(
        r["format"], size_text(r["size"]),
        F.when(r["sharpen_pct"] == 0, F.lit(" sharpen off"))
        .when(r["sharpen_pct"] > 0, F.concat(F.lit(" sharpen "), r["sharpen_pct"].cast("string"), F.lit("%")))
        .otherwise(F.lit("")),
        F.when(r["gray_a"] == 1, F.lit(" gray")).when(r["gray_a"] >= 0, F.lit(" no gray")).otherwise(F.lit("")))
