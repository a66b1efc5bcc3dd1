"""Outcome choice and checks: R8, R16, J13."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def choose_candidate(df: DataFrame) -> DataFrame:
    """Pick the payload to write. Adds fmt, out_bytes, packed, packed_saved.

    needs raw_bytes, png_bytes, jpeg_bytes, use_jpeg, auto_mode, upscaled; optional: lossless variants
    png_opt_bytes, jpeg_opt_bytes, raw_opt_bytes with raw_fmt, and lossless_only (same size and PNG in,
    PNG out: only the original and its lossless variant compete)."""
    def col(name, default):
        return F.col(name) if name in df.columns else F.lit(default)
    raw, png, jpg = F.col("raw_bytes"), F.col("png_bytes"), F.col("jpeg_bytes")
    png_opt, jpg_opt = col("png_opt_bytes", None).cast("long"), col("jpeg_opt_bytes", None).cast("long")
    raw_opt, raw_fmt = col("raw_opt_bytes", None).cast("long"), col("raw_fmt", "PNG")
    lossless = F.coalesce(col("lossless_only", False), F.lit(False))
    takes_jpeg = F.col("use_jpeg") & ~(F.col("auto_mode") & (jpg >= png))
    coded = F.when(takes_jpeg, jpg).otherwise(png)
    back = lossless | (~F.col("upscaled") & (coded >= raw))
    pick = F.when(back, F.lit("raw")).when(takes_jpeg, F.lit("jpeg")).otherwise(F.lit("png"))
    df = df.withColumn("_pick", pick)
    can_opt = raw_fmt.isin("PNG", "JPEG")
    smaller = (F.when(F.col("_pick") == "raw", can_opt & (raw_opt < raw))
               .when(F.col("_pick") == "jpeg", jpg_opt < jpg).otherwise(png_opt < png))
    smaller = F.coalesce(smaller, F.lit(False))
    base = F.when(F.col("_pick") == "raw", raw).when(F.col("_pick") == "jpeg", jpg).otherwise(png)
    opt = F.when(F.col("_pick") == "raw", raw_opt).when(F.col("_pick") == "jpeg", jpg_opt).otherwise(png_opt)
    label = (F.when(F.col("_pick") == "jpeg", F.lit("JPEG")).when(F.col("_pick") == "png", F.lit("PNG"))
             .when(smaller, F.concat(raw_fmt, F.lit("*"))).otherwise(F.lit("orig")))
    packed = smaller & ((F.col("_pick") == "png") | ((F.col("_pick") == "raw") & (raw_fmt == "PNG")))
    out = F.when(smaller, opt).otherwise(base)
    return df.withColumns({"fmt": label, "out_bytes": out, "packed": packed,
                           "packed_saved": F.when(packed, base - opt).otherwise(F.lit(0))}).drop("_pick")


def keep_or(df: DataFrame) -> DataFrame:
    """Assets that are kept leave with their original bytes and label 'keep'."""
    k = F.col("keep")
    return df.withColumn("fmt", F.when(k, F.lit("keep")).otherwise(F.col("fmt"))).withColumn(
        "out_bytes", F.when(k, F.col("raw_bytes")).otherwise(F.col("out_bytes")))


def verify(containers: DataFrame, assets: DataFrame) -> DataFrame:
    """Ok, message and counts per container. The first failing asset (by ord) is named; formats
    nobody decodes are only counted. containers: container_id, rc; assets: fmt, width, ord, asset_id."""
    known = F.col("fmt").isin("PNG", "JPEG", "HDR")
    bad = known & (F.coalesce(F.col("width"), F.lit(0)) <= 0)
    per = assets.groupBy("container_id").agg(
        F.count(F.lit(1)).alias("n_assets"), F.count_if(F.col("fmt") == "HDR").alias("n_hdr"),
        F.count_if(~known).alias("n_other"),
        F.min(F.when(bad, F.struct("ord", "asset_id", "fmt"))).alias("_bad"))
    df = containers.join(per, "container_id", "left")
    broken = (F.col("rc") != 0) & (F.col("rc") != 3)
    ok = ~broken & F.col("_bad").isNull()
    msg = (F.when(F.col("rc") == 3, F.lit("no assets"))
           .when(broken, F.lit("structure broken"))
           .when(F.col("_bad").isNotNull(), F.concat(F.lit("asset "), F.col("_bad.asset_id").cast("string"),
                                                     F.lit(" does not decode")))
           .otherwise(F.concat(F.coalesce("n_assets", F.lit(0)).cast("string"), F.lit(" assets readable"))))
    zero = F.lit(0).cast("long")
    return df.select("container_id", ok.alias("ok"), msg.alias("message"),
                     *[F.coalesce(c, zero).alias(c) for c in ("n_assets", "n_hdr", "n_other")])


def compare_results(a: DataFrame, b: DataFrame, keys, cols, digest=None) -> DataFrame:
    """Keyed comparison: same, changed, only_left, only_right, and how many columns differ.

    ``digest`` names payload columns compared through sha2, so large payloads are hashed before the
    shuffle instead of travelling through it."""
    def prep(df, side):
        vals = [F.col(c).alias(f"{side}_{c}") for c in cols]
        hashed = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{side}_{c}") for c in (digest or [])]
        return df.select(*keys, *vals, *hashed, F.lit(True).alias(f"{side}_in"))
    j = prep(a, "a").join(prep(b, "b"), list(keys), "full_outer")
    names = list(cols) + list(digest or [])
    both = F.col("a_in").isNotNull() & F.col("b_in").isNotNull()
    n = sum((F.when(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), 0).otherwise(1) for c in names), F.lit(0))
    status = (F.when(F.col("b_in").isNull(), F.lit("only_left")).when(F.col("a_in").isNull(), F.lit("only_right"))
              .when(n == 0, F.lit("same")).otherwise(F.lit("changed")))
    return j.select(*keys, status.alias("status"), F.when(both, n).otherwise(F.lit(0)).cast("int").alias("n_diff"))
