"""Vector code compression: product codes whose codebooks come from ball k-means on whole numbers.

Vectors are cut into equal parts and each part position has its own entries. An entry and the parts assigned to it form a
ball. A pass over the table needs the distance of every part to its own entry only: with d that distance and D the
distance of two entries, another entry can be as near only if D <= 2 d. So entries beyond twice the ball's radius are no
neighbours; a part with 2 d below the distance of the nearest neighbour lies in the stable core and keeps its entry
unseen; any other part lies in a ring between two neighbours and is compared with those up to its ring alone. All
distances are whole numbers, so the result is exactly that of comparing with every entry.

Each round is one pass that writes the table with its new codes and a few rows of sums for each task; only these sums
(parts x entries rows) come to the driver. The table of the round before is then deleted.
"""
import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import discard, materialise

STATE = "vec_id long, label_key string, v array<int>, code binary, part int, entry int, n long, sums array<long>, far long"
FINAL = "vec_id long, label_key string, code string, error long"
LIMIT = 2**27  # components; squared distances of parts then fit in a long
BLOCK = 4096  # rows compared at once


def squared(a, b):
    d = a - b
    return (d * d).sum(axis=-1)


class Balls:
    """The entries of one part position, their mutual distances and each ball's neighbours, the nearest first.

    ``radius``: for each ball at least the distance of its farthest part, or None where nothing is assigned yet.
    """

    def __init__(self, entries, radius=None):
        self.entries, self.radius = entries, radius
        m = len(entries)
        between = squared(entries[:, None, :], entries[None, :, :])
        np.fill_diagonal(between, -1)
        self.order = np.argsort(between, axis=1, kind="stable")[:, 1:]
        self.between = np.take_along_axis(between, self.order, 1)
        if radius is not None:
            self.between[self.between > 4 * (np.array(radius, np.int64) ** 2)[:, None]] = np.iinfo(np.int64).max
        self.m = m

    def nearest(self, parts, code=None):
        """Nearest entry and squared distance of each part, ties to the lower entry; ``code``: the entries so far."""
        if code is None:
            distance = np.stack([squared(parts, e) for e in self.entries], 1)
            code = distance.argmin(axis=1)
            return code, distance[np.arange(len(parts)), code]
        code = code.copy()
        own, best = code.copy(), squared(parts, self.entries[code])
        ring = (self.between[own] <= 4 * best[:, None]).sum(axis=1)  # neighbours that may be as near; none in the core
        for k in range(int(ring.max(initial=0))):
            at = np.flatnonzero(ring > k)
            other = self.order[own[at], k]
            distance = squared(parts[at], self.entries[other])
            nearer = (distance < best[at]) | ((distance == best[at]) & (other < code[at]))
            best[at[nearer]], code[at[nearer]] = distance[nearer], other[nearer]
        return code, best


def _numbers(column, width, scale):
    """A list column as whole numbers, short vectors padded with zeros; scale None: they are whole numbers already."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat.astype(np.int64) if scale is None else np.floor(flat.astype(np.float64) * scale).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _lists(values):
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _assigned(batches, balls, width, scale, first):
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            b = batch.slice(i, BLOCK)
            v = _numbers(b.column("v"), width, scale if first else None)
            parts = v.reshape(len(v), len(balls), width // len(balls))
            old = None if first else np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(v), len(balls)).astype(np.int64)
            found = [x.nearest(parts[:, p], None if first else old[:, p]) for p, x in enumerate(balls)]
            yield b, v, parts, np.stack([c for c, _ in found], 1), np.stack([d for _, d in found], 1)


def _round(balls, width, scale, first):
    """Assigns every part; the last rows of a task hold its sums for each part and entry."""
    def run(batches):
        p, m, w = len(balls), balls[0].m, width // len(balls)
        n, sums, far = np.zeros((p, m), np.int64), np.zeros((p, m, w), np.int64), np.zeros((p, m), np.int64)
        for b, v, parts, code, d in _assigned(batches, balls, width, scale, first):
            for i in range(p):
                chosen = code[:, i, None] == np.arange(m)
                n[i] += chosen.sum(axis=0)
                sums[i] += chosen.T.astype(np.int64) @ parts[:, i]
                np.maximum.at(far[i], code[:, i], d[:, i])
            size = len(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label_key"), _lists(v.astype(np.int32)), pa.array([x.tobytes() for x in code.astype(np.uint8)], pa.binary()),
                 pa.nulls(size, pa.int32()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.list_(pa.int64())),
                 pa.nulls(size, pa.int64())], names=["vec_id", "label_key", "v", "code", "part", "entry", "n", "sums", "far"])
        i, k = np.nonzero(n)
        size = len(i)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(size, pa.int64()), pa.nulls(size, pa.string()), pa.nulls(size, pa.list_(pa.int32())), pa.nulls(size, pa.binary()),
             pa.array(i.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(n[i, k]), _lists(sums[i, k]), pa.array(far[i, k])],
            names=["vec_id", "label_key", "v", "code", "part", "entry", "n", "sums", "far"])
    return run


def _finish(balls, width):
    def run(batches):
        for b, _, _, code, d in _assigned(batches, balls, width, None, False):
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label_key"), pa.array([x.tobytes().hex() for x in code.astype(np.uint8)], pa.string()),
                 pa.array(d.sum(axis=1))], names=["vec_id", "label_key", "code", "error"])
    return run


def _moved(balls, stats):
    """The balls after one round: entries at the floored means of their parts, radii that still hold every part."""
    entries, far = [b.entries.copy() for b in balls], [np.zeros(b.m, np.int64) for b in balls]
    for r in stats:
        entries[r["part"]][r["entry"]] = np.array([s // r["n"] for s in r["sums"]], np.int64)
        far[r["part"]][r["entry"]] = r["far"]
    out = []
    for b, e, f in zip(balls, entries, far):
        shift = squared(b.entries, e)
        out.append(Balls(e, [isqrt(int(x)) + isqrt(int(y)) + 2 for x, y in zip(f, shift)]))
    return out


def vector_codes(rows: DataFrame, vector: str = "embedding", ident: str = "vec_id", label: str = "label", parts: int = 8, entries: int = 16,
                 rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """Codes and codebooks: one row for each vector kept, with vec_id, label_key (the label as text), code (two hex digits
    for each part) and error (long); and the final entries as an array (part, entry, position), which has at most
    ``parts * entries`` rows whatever the table's size.

    Components become floor(scale * x). The ``entries`` (256 at most) smallest ids start the codebooks, ascending (null ids
    last, equal ids by vector); fewer vectors give fewer entries. Rows whose vector is null or has a null or non-finite
    component are dropped; repeated rows and null ids are vectors like others. A length that ``parts`` does not divide, and
    vectors shorter than the longest (empty ones too), are padded with zeros. Whole components beyond 2^27 raise a
    ValueError. An empty table gives an empty result; other columns are ignored.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    kept = rows.where(x.isNotNull() & finite).select(
        F.col(ident).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label_key"), x.alias("v"))
    most = F.coalesce(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))), F.lit(0.0))
    size, large = kept.agg(F.max(F.size("v")), F.max(most)).first()
    if size is None:
        return rows.sparkSession.createDataFrame([], FINAL), np.zeros((parts, 0, 0), np.int64)
    if large * scale + 1 > LIMIT:
        raise ValueError("components exceed 27 bits; use a smaller scale")
    width = -(-size // parts) * parts
    seeds = np.zeros((0, width), np.int64)
    for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect():
        one = np.zeros((1, width), np.int64)
        one[0, :len(r.v)] = np.floor(np.array(r.v, np.float64) * scale)
        seeds = np.concatenate([seeds, one])
    balls = [Balls(s) for s in np.split(seeds, parts, axis=1)]
    state, table = kept, None
    for k in range(rounds):
        new = materialise(state.mapInArrow(_round(balls, width, scale, k == 0), STATE))
        if table is not None:
            discard(table)
        table, state = new, new.where(F.col("part").isNull()).select("vec_id", "label_key", "v", "code")
        sums = F.array(*[F.sum(F.col("sums")[i]) for i in range(width // parts)]) if width else F.array().cast("array<long>")
        stats = table.where(F.col("part").isNotNull()).groupBy("part", "entry").agg(
            F.sum("n").alias("n"), sums.alias("sums"), F.max("far").alias("far"))
        balls = _moved(balls, stats.collect())
    coded = materialise(state.mapInArrow(_finish(balls, width), FINAL))
    discard(table)
    return coded, np.stack([b.entries for b in balls])


def with_label_errors(coded: DataFrame) -> DataFrame:
    """label_error: the errors of all vectors with the same label, nulls together."""
    total = coded.groupBy("label_key").agg(F.sum("error").alias("label_error")).withColumnRenamed("label_key", "_label")
    return coded.join(total, coded["label_key"].eqNullSafe(total["_label"]), "left").drop("_label")


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
