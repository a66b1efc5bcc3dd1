"""Hard-negative mining: exact scores by residue-number-system GEMM, then windowed selection.

Every component becomes the whole number floor(scale * x). Scores are inner products of such vectors, far beyond what
float32 holds exactly, so they are computed modulo several small primes: residues are centred, a slice of at most
``slice_width`` components keeps every partial sum of a float32 matrix product below 2^24, and each product is reduced
again. The Chinese remainder theorem (mixed radix, centred digits) gives the exact signed score back.

Anchors are dealt into groups of bounded size, all rows into strips; a cell (group, strip) is one key of a shuffle and one
task streams its rows past its anchors. A cell keeps only the few best of each anchor, which a window then ranks over all
cells. Pass one finds the positives, pass two the negatives inside each positive's score window.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlake.llm.common import materialise

EXACT = 2**24  # whole numbers up to here are exact in float32
GROUP, GROUP_COMPONENTS, STRIP = 8192, 2**22, 2**20
TILE = (512, 4096)
NONE = -2**62
LAST = 2**63 - 1
CELL = "a_row long, a_id long, k int, row long, id long, score long"


def moduli(bound: int) -> list[int]:
    """The largest primes below 1024 whose product exceeds 8 * bound: centred digits may then miss their range by a few
    without leaving the one representative between -bound and bound."""
    out, product, p = [], 1, 1023
    while product <= 8 * bound + 8:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def slice_width(p: int) -> int:
    """Components that one float32 product may sum without leaving the exact range."""
    return EXACT // ((p + 1) // 2 + 1) ** 2


def centred(x, p):
    """A representative of x modulo p near zero; x whole numbers below 2^24 in float32."""
    x -= np.rint(x * np.float32(1 / p)) * np.float32(p)
    return x


class Residues:
    """The residues of whole-number vectors (float64, one a row) for each modulus."""

    def __init__(self, values, primes):
        self.parts = []
        for p in primes:
            r = np.fmod(values, p)
            self.parts.append((r - np.rint(r / p) * p).astype(np.float32))

    def __getitem__(self, rows):
        out = object.__new__(Residues)
        out.parts = [x[rows] for x in self.parts]
        return out


def product(a: Residues, b: Residues, primes) -> np.ndarray:
    """Exact inner products (int64) of every row of a with every row of b."""
    digits = []
    for k, p in enumerate(primes):
        x, y, step, total = a.parts[k], b.parts[k], slice_width(p), None
        for i in range(0, max(1, x.shape[1]), step):
            part = centred(x[:, i:i + step] @ y[:, i:i + step].T, p)
            total = part if total is None else centred(total + part, p)
        for q, digit in zip(primes, digits):
            inverse = pow(q, -1, p)
            total = centred((total - digit) * np.float32(inverse if inverse <= p // 2 else inverse - p), p)
        digits.append(total)
    score = digits[-1].astype(np.int64)
    for p, digit in zip(primes[-2::-1], digits[-2::-1]):
        score *= p
        score += digit.astype(np.int64)
    return score


def first_columns(score, n):
    """Column and value of the n largest of each row, the first column first among equals; ``score`` is overwritten."""
    rows = np.arange(len(score))
    cols, values = [], []
    for _ in range(min(n, score.shape[1])):
        c = score.argmax(axis=1)
        cols.append(c)
        values.append(score[rows, c])
        score[rows, c] = NONE
    return np.stack(cols, 1), np.stack(values, 1)


class Best:
    """The n best (score, id, row) of each of m questions so far: higher scores, then smaller ids, then smaller rows."""

    def __init__(self, m, n):
        self.score, self.id, self.row, self.n = np.full((m, n), NONE), np.full((m, n), LAST), np.full((m, n), LAST), n

    def add(self, at, score, ids, rows):
        s = np.concatenate([self.score[at], score], 1)
        i, r = np.concatenate([self.id[at], ids], 1), np.concatenate([self.row[at], rows], 1)
        order = np.lexsort((r, i, -s))[:, :self.n]
        for mine, new in ((self.score, s), (self.id, i), (self.row, r)):
            mine[at] = np.take_along_axis(new, order, 1)


def matrix(column, width, scale) -> np.ndarray:
    """floor(scale * x) of a list column as float64 (exact: no rounding beyond the product by a power of two), short
    vectors padded with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        out = flat.reshape(len(sizes), width)
    else:
        out = np.zeros((len(sizes), width))
        out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return np.floor(out * scale)


class Cell:
    """One group of anchors, and the best rows that a strip has for them."""

    def __init__(self, primes, width, scale, keep, windows):
        self.primes, self.width, self.scale, self.keep, self.windows = primes, width, scale, keep, windows
        self.anchors, self.ready = [], None

    def add_anchors(self, batch):
        self.anchors.append(batch)

    def start(self):
        t = pa.Table.from_batches(self.anchors).combine_chunks()
        vectors = t.column("vector").combine_chunks()
        self.row, self.id, self.label = (t.column(c).to_numpy() for c in ("row", "id", "label"))
        self.ready = Residues(matrix(vectors, self.width, self.scale), self.primes)
        if self.windows:
            self.low, self.high = (np.stack([t.column(f"{c}{k}").to_numpy() for k in range(self.windows)]) for c in ("low", "high"))
        self.best = [Best(len(self.row), self.keep) for _ in range(max(1, self.windows))]

    def add_rows(self, batch):
        if not self.anchors:
            return
        if self.ready is None:
            self.start()
        row, ids, label = (batch.column(c).to_numpy() for c in ("row", "id", "label"))
        order = np.lexsort((row, ids))
        values = matrix(batch.column("vector"), self.width, self.scale)[order]
        row, ids, label = row[order], ids[order], label[order]
        for j in range(0, len(row), TILE[1]):
            cols = slice(j, j + TILE[1])
            strip = Residues(values[cols], self.primes)
            for i in range(0, len(self.row), TILE[0]):
                at = slice(i, i + TILE[0])
                score = product(self.ready[at], strip, self.primes)
                same = self.label[at, None] == label[None, cols]
                if not self.windows:
                    score[~same | (self.row[at, None] == row[None, cols])] = NONE
                    self.take(self.best[0], at, score, ids[cols], row[cols])
                    continue
                score[same] = NONE
                for k, best in enumerate(self.best):
                    low, high = self.low[k, at, None], self.high[k, at, None]
                    inside = np.where((score >= low) & (score <= high), score, NONE)
                    self.take(best, at, inside, ids[cols], row[cols])

    def take(self, best, at, score, ids, row):
        c, v = first_columns(score, self.keep)
        best.add(at, v, np.where(v > NONE, ids[c], LAST), np.where(v > NONE, row[c], LAST))

    def result(self):
        if self.ready is None:
            return
        for k, best in enumerate(self.best):
            a, c = np.nonzero(best.score > NONE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.row[a]), pa.array(self.id[a]), pa.array(np.full(len(a), k, np.int32)), pa.array(best.row[a, c]),
                 pa.array(best.id[a, c]), pa.array(best.score[a, c])], names=["a_row", "a_id", "k", "row", "id", "score"])


def _cells(primes, width, scale, keep, windows):
    def run(batches):
        key, cell = None, None
        for batch in batches:
            g, r, kind = (batch.column(c).to_numpy() for c in ("g", "r", "kind"))
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(r) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(g)]):
                if a == b:
                    continue
                if (g[a], r[a]) != key:
                    if cell:
                        yield from cell.result()
                    key, cell = (g[a], r[a]), Cell(primes, width, scale, keep, windows)
                (cell.add_rows if kind[a] else cell.add_anchors)(batch.slice(a, b - a))
        if cell:
            yield from cell.result()
    return run


def _ranked(found, keep):
    """The best of all cells, numbered from 1."""
    w = Window.partitionBy("a_row", "k").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def hard_negatives(rows: DataFrame, anchor, vector: str = "embedding", ident: str = "vec_id", label: str = "label", scale: int = 256,
                   positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """One row for each negative found: anchor_id, positive_id, rank (int, from 1), negative_id, positive_score,
    negative_score (long). ``anchor`` is a condition on the rows of ``rows``; labels are whole numbers.

    An anchor's positives are its ``positives`` best other rows of the same label, and the negatives of a positive the
    ``negatives`` best rows of another label whose score lies between ``low`` and ``high`` percent of the positive's.
    Higher scores come first, ties by smaller id, null ids last. Rows with a null label, a null vector or a null or
    non-finite component take no part; vectors shorter than the longest (empty ones too) are padded with zeros. Repeated
    rows are rows like others: each may be an anchor, and each may be the positive or negative of another. A null id is no
    anchor. Scores that may leave 55 bits raise a ValueError. Without anchors the result is empty; other columns are ignored.
    """
    spark = rows.sparkSession
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    kept = rows.where(F.col(label).isNotNull() & v.isNotNull() & finite)
    kept = materialise(kept.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(ident).cast("long"), F.lit(LAST)).alias("id"),
        F.col(label).cast("long").alias("label"), v.alias("vector"),
        F.coalesce(anchor & F.col(ident).isNotNull(), F.lit(False)).alias("anchor")))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x.cast("double")) * scale + 1, F.lit(2.0)))
    n, anchors, width, norm = kept.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("vector")), F.max(square)).first()
    if (norm or 0) >= 2.0**55:
        raise ValueError("scores may exceed 55 bits; use a smaller scale")
    primes = moduli(int(norm or 0) + 1)  # no inner product exceeds the largest squared length
    groups = max(1, -(-anchors // max(1, min(GROUP, GROUP_COMPONENTS // max(1, width or 1)))))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    strips = max(1, -(-tasks // groups), -(-n // STRIP))

    def cells(asked, keep, windows):
        more = [f"{c}{k}" for c in ("low", "high") for k in range(windows)]
        cols = ["row", "id", "label", "vector"]
        group = lambda c: F.pmod(F.xxhash64(F.lit(1), c), F.lit(groups)).cast("int")
        strip = F.pmod(F.xxhash64(F.lit(2), "row"), F.lit(strips)).cast("int")
        each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        a = asked.select(group("row").alias("g"), each(strips).alias("r"), F.lit(0).alias("kind"), *cols, *more)
        b = kept.select(each(groups).alias("g"), strip.alias("r"), F.lit(1).alias("kind"), *cols, *[F.lit(None).cast("long").alias(c) for c in more])
        both = a.unionByName(b).repartition(groups * strips, "g", "r").sortWithinPartitions("g", "r", "kind")
        return _ranked(both.mapInArrow(_cells(primes, width or 0, scale, keep, windows), CELL), keep)

    asked = kept.where("anchor")
    near = materialise(cells(asked, positives, 0).select("a_row", "a_id", (F.col("rank") - 1).alias("k"), "id", "score"))
    # ceil(low * score / 100) and floor(high * score / 100) on whole numbers
    windows = near.groupBy("a_row").agg(*[
        f(F.when(F.col("k") == k, x)).alias(f"{name}{k}") for k in range(positives) for name, f, x in (
            ("low", F.max, F.expr(f"-((-{low} * score - pmod(-{low} * score, 100)) div 100)")),
            ("high", F.max, F.expr(f"({high} * score - pmod({high} * score, 100)) div 100")))])
    filled = [F.coalesce(f"{c}{k}", F.lit(e)).alias(f"{c}{k}") for c, e in (("low", 0), ("high", NONE)) for k in range(positives)]
    asked = asked.join(windows, asked["row"] == windows["a_row"]).select("row", "id", "label", "vector", *filled)
    found = cells(asked, negatives, positives).select("a_row", "k", "rank", F.col("id").alias("n_id"), F.col("score").alias("n_score"))
    named = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return near.join(found, ["a_row", "k"]).select(
        named("a_id").alias("anchor_id"), named("id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        named("n_id").alias("negative_id"), F.col("score").alias("positive_score"), F.col("n_score").alias("negative_score"))
