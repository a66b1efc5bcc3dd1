"""Orderings and rankings: W2-W9, X4, X5."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlake.functions import keys
from assetlake.functions.classify import class_ord
from assetlake.functions.text import parse_display_number


def order_by_class(df: DataFrame, *after) -> DataFrame:
    """W2."""
    return df.orderBy(class_ord(F.col("class")), *after)


def order_parts(df: DataFrame) -> DataFrame:
    """Per container, parts with assets first, then by key."""
    return df.orderBy("container_id", F.col("n_assets") == 0, "owner_key")


def order_assets(df: DataFrame) -> DataFrame:
    """Assets of a part by bytes descending, id breaks ties. A range-partitioned sort on the whole
    key, so one hot part spreads over many tasks."""
    return df.orderBy("container_id", "owner_key", F.col("n_bytes").desc(), "asset_id")


def sort_table(df: DataFrame, column: str, kind: str, desc: bool) -> DataFrame:
    """Sort displayed cells as numbers; empty cells last in both directions, ties in part order.

    The name column only sorts ascending in part order."""
    pos = keys.owner_order(F.col("owner_key"))
    if kind == "name":
        return df.orderBy(pos.asc(), F.col(column).asc())
    empty = F.col(column).isNull() | F.trim(column).isin("", "—")
    value = F.when(~empty, parse_display_number(F.col(column), kind))
    return df.orderBy(value.desc_nulls_last() if desc else value.asc_nulls_last(), pos.asc(), *df.columns)


def cap_details(df: DataFrame, n: int, by=("container_id", "kind"), ord=("ord",)) -> DataFrame:
    """First n rows per key. The rank filter runs per task before the exchange (window group limit),
    so a hot key ships at most n rows from each task."""
    w = Window.partitionBy(*by).orderBy(*ord)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


SAMPLED = 20  # rows of the sample for each slice: slices then differ by about a fifth in size


def _sliced(df: DataFrame, key: Column, n_slices: int) -> DataFrame:
    """``df`` with the slice (_slice: 0, 1, ...) of each row in the order of ``key``, an orderable struct.

    Bounds are every 20th of a sample of some 20 rows a slice, kept in order by one aggregate (a few thousand keys at most)
    and read as a scalar subquery. A row is in the sample by the hash of its key alone, so every reader of ``df`` cuts it at
    the same places and nothing has to be written down in between."""
    total = df.agg(F.count(F.lit(1))).scalar()
    rate = F.greatest(F.floor(total / F.lit(SAMPLED * n_slices)), F.lit(1))
    sample = df.select(key.alias("k")).where(F.pmod(F.xxhash64(F.lit(3), "k"), rate) == 0)
    bounds = sample.agg(F.sort_array(F.collect_set("k")).alias("b")).select(F.filter("b", lambda x, i: i % SAMPLED == SAMPLED - 1)).scalar()
    return df.withColumn("_bounds", bounds).withColumn("_slice", _place(F.col("_bounds"), key, n_slices)).drop("_bounds")


def _place(bounds: Column, key: Column, most: int) -> Column:
    """How many of the sorted ``bounds`` (a sample: about ``most``) are not above ``key``, by binary search. The key is bound to a
    variable, or each step would make it anew; the result is never null, or joins on it would compute it once more."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length() + 2))])

    def search(k):
        return F.aggregate(steps, F.lit(0), lambda low, step: F.when(
            (low + step <= F.size(bounds)) & (F.get(bounds, low + step - 1) <= k), low + step).otherwise(low))
    return F.coalesce(F.get(F.transform(F.array(key), search), F.lit(0)), F.lit(0))


def rank_within(df: DataFrame, by, order, name: str = "rank", buckets: int = None) -> DataFrame:
    """Row number per key without putting a key into one task, by distributed prefix sums.

    ``order``: columns, ascending (negate a number to turn it round). Rows are cut into slices of the order (key, order); a
    window numbers each slice of a key, the slices' counts add up along a key, and a row's number is its place in its slice
    plus what stands before. Rows equal in key and order are told apart by a hash of their values; only rows equal in all
    columns cannot be told apart, and share a slice. ``df`` must give the same rows each time it is read. ``buckets``: the
    number of slices (default: the session's shuffle partitions, at most 256, as every task holds their bounds)."""
    by, order = list(by), [F.col(c) if isinstance(c, str) else c for c in order]
    n = min(buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 256)
    tie = F.xxhash64(*df.columns)
    key = F.struct(*[F.col(c) for c in by], *[o.alias(f"o{i}") for i, o in enumerate(order)], tie.alias("tie"))
    cut = _sliced(df, key, n)
    sizes = cut.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    w = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_slice").alias("_s"), F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_off"))
    numbered = cut.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(*order, tie)))
    same = F.col("_slice") == F.col("_s")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    j = numbered.join(offsets, same)
    return j.withColumn(name, F.col("_n") + F.col("_off")).select(*df.columns, name)


def dedupe_names(df: DataFrame, existing: DataFrame, order=("path",)) -> DataFrame:
    """Collision-free output names. df: rel_dir, stem, ...; existing: rel_dir, stem (taken names).

    The first file of a free stem keeps it; others get _2, _3, ... Numbers start after the highest
    suffix already taken for that stem, by an existing name or by an input stem of that very form, so
    generated names cannot collide with each other or with anything present."""
    place = ["rel_dir", "_base"]
    pat = r"^(.*)_([0-9]+)\z"
    taken = existing.select("rel_dir", "stem").unionByName(df.select("rel_dir", "stem")).distinct()
    suffix = taken.select("rel_dir", F.regexp_extract("stem", pat, 1).alias("_base"),
                          F.regexp_extract("stem", pat, 2).try_cast("long").alias("_k"))
    top = suffix.where("_k is not null").groupBy(*place).agg(F.max("_k").alias("_top"))
    used = existing.select("rel_dir", F.col("stem").alias("_base")).distinct().withColumn("_used", F.lit(1))
    ranked = rank_within(df.withColumn("_base", F.col("stem")), place, order, "_rank")
    j = ranked.join(top, place, "left").join(used, place, "left")
    pos = F.col("_rank") + F.coalesce("_used", F.lit(0))
    number = F.greatest(F.coalesce("_top", F.lit(1)), F.lit(1)) + pos - 1
    out = F.when(pos == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), number.cast("string")))
    return j.withColumn("out_stem", out).drop("_rank", "_top", "_used", "_base")


def order_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Case-insensitive, the exact path breaks ties."""
    return df.orderBy(F.lower(path), path)


def hist_quantile(df: DataFrame, by, value: Column, q: float = 0.95, floor: int = 4) -> DataFrame:
    """First bucket >= 1 of a 256-bucket histogram whose running count reaches int(q * n), at least
    ``floor``. The running sum sees at most 256 rows per key.

    Counting starts at bucket 1; when even bucket 255 does not reach the target the answer is 256."""
    by = list(by)
    b = F.least(F.greatest(value.cast("int"), F.lit(0)), F.lit(255))
    hist = df.groupBy(*by, b.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    per = Window.partitionBy(*by)
    run = F.sum(F.when(F.col("_b") >= 1, F.col("_c")).otherwise(F.lit(0))).over(
        per.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    h = hist.withColumn("_run", run).withColumn("_n", F.sum("_c").over(per))
    want = F.floor(F.col("_n") * F.lit(float(q)))
    first = F.min(F.when((F.col("_b") >= 1) & (F.col("_run") >= want), F.col("_b")))
    out = h.groupBy(*by).agg(first.alias("_q"), F.max(want).alias("_want"))
    ref = F.when(F.col("_want") <= 0, F.lit(1)).otherwise(F.coalesce("_q", F.lit(256)))
    return out.select(*by, F.greatest(ref, F.lit(floor)).cast("int").alias("quantile"))


def union_inputs(*dfs) -> DataFrame:
    """Union of several inputs with the position of their input."""
    out = None
    for i, d in enumerate(dfs):
        d = d.withColumn("input_no", F.lit(i))
        out = d if out is None else out.unionByName(d)
    return out


def coverage_audit(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Total texts, distinct texts and distinct texts without a translation. Columns: text / source."""
    counts = texts.groupBy("text").agg(F.count(F.lit(1)).alias("_n"))
    known = terms.select(F.col("source").alias("text")).distinct().withColumn("_k", F.lit(True))
    j = counts.join(known, "text", "left")
    return j.agg(F.sum("_n").alias("n_total"), F.count(F.lit(1)).alias("n_distinct"),
                 F.count_if(F.col("_k").isNull()).alias("n_missing"))


def missing_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """X5, the list: distinct texts no term covers."""
    return texts.select("text").distinct().join(
        terms.select(F.col("source").alias("text")), "text", "left_anti")
