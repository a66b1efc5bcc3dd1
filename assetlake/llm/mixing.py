"""Mixing sources to target weights by entropy balancing, DataFrame operations only.

Every source gets a token target. Among all document rates r with sum(r * size) = target and r <= cap, those closest to
one copy each (least relative entropy) are r = min(cap, exp(lambda * size / mean size)): one dual variable a source, whose
convex dual is solved by Newton steps. A step is one aggregation of the histogram (source, size, documents), which holds
all that the dual needs; only the largest error comes to the driver. Sums are decimal, so that reruns agree to the last
digit. Rates become whole copies by systematic rounding along the sizes of a source; of 64 starting points the one that
comes nearest to the target is taken.
"""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlake.llm.common import materialise, row_key

UNIT = 1_000_000  # rates are rounded to millionths before they become copies
STARTS = 64
BUCKET = 4096  # documents of equal source and size that are ranked together


def document_sizes(docs: DataFrame) -> DataFrame:
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       row_key().alias("row_key"), F.coalesce(words, F.lit(0)).cast("long").alias("size"))


def source_targets(hist: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """hist (source, size, n) to one row for each source: sid (its rank by code point, null last), source, docs,
    source_size and target. Targets are ``share`` of all sizes by weight; above ``cap`` times the source's size a target
    stops, and the excess goes to the others by weight, again and again."""
    s = hist.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    s = materialise(s.orderBy(F.col("source").asc_nulls_last()).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    before = s.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # one row for each partition of the sorted sources
    before = before.withColumn("_before", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("_p", part).join(before.drop("_n"), "_p")
    sid = F.coalesce("_before", F.lit(0)) + F.col("_m").bitwiseAND((1 << 33) - 1)
    s = s.select(sid.alias("sid"), "source", "docs", "source_size")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    s = materialise(s.withColumn("weight", w))
    most = F.col("source_size") * F.lit(cap)
    total, all_weight = s.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return s.withColumn("target", F.lit(0.0))
    level, stopped = share * total / all_weight, -1
    while True:
        above = F.lit(level) * F.col("weight") > most
        n, held, open_weight = s.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, most)), F.lit(0.0)),
                                     F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == stopped or not open_weight:
            break
        stopped, level = n, (share * total - held) / open_weight
    return s.withColumn("target", F.when(above, most).otherwise(F.lit(level) * F.col("weight")))


def _rate(cap):
    r = F.least(F.lit(cap), F.exp(F.col("lam") * F.col("size") / F.col("mean")))
    return F.when(F.col("target") >= cap * F.col("source_size"), F.lit(cap)).when(F.col("target") <= 0, F.lit(0.0)).otherwise(r)


def solve_dual(hist: DataFrame, sources: DataFrame, cap: float = 2.0, steps: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """hist (sid, size, n) and sources to sources with ``lam``, the dual variable, and ``mean``. Newton steps are kept
    inside the bracket known so far; the error is the distance to the target in parts of it."""
    none = F.lit(None).cast("double")
    state = sources.withColumn("mean", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)))
    state = materialise(state.select(*sources.columns, "mean", F.lit(0.0).alias("lam"), none.alias("lo"), none.alias("hi")))
    keep = [*sources.columns, "mean"]
    exact = lambda x: F.sum(F.round(x, 4).cast("decimal(38,4)")).cast("double")  # noqa: E731  the same in any order
    for _ in range(steps):
        words = F.col("n") * F.col("size") * _rate(cap)
        slope = F.when(_rate(cap) < cap, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = hist.join(state.drop("source"), "sid").groupBy("sid").agg(exact(words).alias("_w"), exact(slope).alias("_s"))
        s = state.join(sums, "sid").withColumn("_g", F.col("_w") - F.col("target"))
        s = s.withColumn("lo", F.when(F.col("_g") < 0, F.col("lam")).otherwise(F.col("lo")))
        s = s.withColumn("hi", F.when(F.col("_g") > 0, F.col("lam")).otherwise(F.col("hi")))
        step = F.when(F.col("_s") > 0, F.greatest(F.lit(-4.0), F.least(F.lit(4.0), -F.col("_g") / F.col("_s")))).otherwise(-4 * F.signum("_g"))
        s = s.withColumn("_t", F.col("lam") + step)
        outside = (F.col("_t") <= F.col("lo")) | (F.col("_t") >= F.col("hi"))
        s = s.withColumn("_t", F.when(F.coalesce(outside, F.lit(False)) & F.col("lo").isNotNull() & F.col("hi").isNotNull(),
                                      (F.col("lo") + F.col("hi")) / 2).otherwise(F.col("_t")))
        fixed = (F.col("target") >= cap * F.col("source_size")) | (F.col("target") <= 0)
        err = F.when(fixed, F.lit(0.0)).otherwise(F.abs("_g") / F.col("target"))
        s = s.withColumn("_err", err)
        s = s.withColumn("lam", F.when(F.col("_err") <= tolerance, F.col("lam")).otherwise(F.col("_t")))
        state = materialise(s.select(*keep, "lam", "lo", "hi", "_err"))
        worst = state.agg(F.max("_err")).first()[0]
        state = state.drop("_err")
        if worst is None or worst <= tolerance:
            break
    return state


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size (words), source_size, target (of its source), copies (0 to
    ``cap``) and taken (copies times size).

    Null and empty texts have size 0 and add nothing; the null source is a source, the last one. Rows are taken as they
    are, so repeated rows and a null doc_id count like others (equal rows may swap their copies, which cannot be seen). An
    empty table gives an empty result. Extra columns are ignored.
    """
    sizes = materialise(document_sizes(docs))
    hist = materialise(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = materialise(source_targets(hist, weights, share, cap))
    named = sources.select("sid", F.col("source").alias("_s"))
    hist = materialise(hist.join(named, F.col("source").eqNullSafe(F.col("_s"))).select("sid", "size", "n"))
    solved = solve_dual(hist, sources, float(cap))

    g = hist.join(solved, "sid").withColumn("q", F.round(_rate(float(cap)) * UNIT).cast("long") * F.col("n"))
    along = Window.partitionBy("sid").orderBy(F.col("size").desc())
    g = materialise(g.select("sid", "source", "size", "n", "source_size", "target", "q", F.sum("q").over(along).alias("upto")))
    whole_copies = F.expr(f"(upto + start * {UNIT // STARTS}) div {UNIT}") - F.expr(f"(upto - q + start * {UNIT // STARTS}) div {UNIT}")
    tried = g.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    tried = tried.groupBy("sid", "start").agg(F.abs(F.sum(whole_copies * F.col("size")) - F.first("target")).alias("miss"))
    best = tried.groupBy("sid").agg(F.min(F.struct("miss", "start")).alias("b")).select("sid", F.col("b.start").alias("start"))
    g = g.join(best, "sid").withColumn("total", whole_copies)
    g = g.select("sid", "source", "size", "n", "source_size", "target", "total", F.ceil(F.col("n") / BUCKET).cast("long").alias("buckets"))
    g = materialise(g.withColumnRenamed("source", "_s").withColumnRenamed("size", "_z"))

    d = sizes.join(g, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    d = materialise(d.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row_key"), "buckets"))
                    .select("doc_id", "source", "row_key", "size", "sid", "n", "source_size", "target", "total", "bucket"))
    cells = d.groupBy("sid", "size", "bucket").agg(F.count("*").alias("_c"))
    cells = cells.withColumn("_before", F.coalesce(F.sum("_c").over(
        Window.partitionBy("sid", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    k = F.row_number().over(Window.partitionBy("sid", "size", "bucket").orderBy("doc_id", "row_key"))
    d = d.withColumn("_k", k).join(cells, ["sid", "size", "bucket"]).withColumn("_k", F.col("_k") + F.col("_before"))
    copies = F.expr("(_k * total) div n - ((_k - 1) * total) div n")
    return d.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
