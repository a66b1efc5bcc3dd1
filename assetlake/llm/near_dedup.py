"""MinHash near-dedup: universal hash minima in bands, signature verification, exact confirmation and components.

1. Each text becomes a digest of its shingle set, the minima of 200 universal hashes as 40 band keys of five minima,
   and a sketch of two bits from each of 192 minima. Texts with equal sets are one node from then on.
2. Nodes that share a band key are candidates: at a similarity of 0.8 a pair is missed with probability 1.2e-7.
3. Pairs are compared in three rounds, so that a large bucket never lists all its pairs: every member with the bucket's
   centre (the member that shares most buckets with most others), then with a random centre of the bucket if not yet in
   its component. What still lies in different components of a bucket meets by its rare shingles: in one order of all
   shingles, the rarest first, texts of n and m shingles that reach the threshold have their first common shingle within
   the first n - a + 1 and m - a + 1, where a is the overlap they need; so only these prefixes are joined, and of a
   shingle's texts the smaller components ask the others. Only pairs whose sizes and sketches allow the threshold leave a
   join (the sketch test loses a true pair with probability below 1e-8).
4. These pairs are confirmed on the full sets; components come from alternating large-star and small-star.
No bucket, partner or candidate is capped.
"""
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import WordHashes, gram_hashes, materialise, row_key, scramble, whole
from assetlake.llm.components import components

BANDS, ROWS, SEED = 40, 5, 20240607
PLANES, SKETCH = 2, 192
#: Differing minima of 192 at most. At a similarity of 0.8 two bits agree with probability 0.85: 28.8 +- 4.9 differ.
MAX_DIFFERENT = 60
S = [f"s{i}" for i in range(PLANES * SKETCH // 64)]
FEATURES = "doc_id long, row_key long, n_shingles long, d1 long, d2 long, keys array<long>, " + ", ".join(f"{s} long" for s in S)


def shingles(text: str, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; fewer words are one shingle; none without words."""
    words = text.encode().lower().split()  # bytes: only A-Z lower, only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    h = hashes(words)
    return np.unique(gram_hashes(h, k) if len(h) >= k else scramble(gram_hashes(h, len(h)) + np.uint64(len(h))))


def digest(grams: np.ndarray) -> tuple[int, int]:
    return np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.int64)


class MinHash:
    """Minima of universal hashes a * x + b modulo 2^64 (a odd)."""

    def __init__(self, bands=BANDS, rows=ROWS, seed=SEED):
        r = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = r.integers(0, 2**63, bands * rows, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 2**63, bands * rows, np.uint64)[:, None] * np.uint64(2)

    def minima(self, grams):
        low = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(grams), 512):
            h = self.a * grams[None, i:i + 512]
            h += self.b
            np.minimum(low, h.min(axis=1), out=low)
        return low

    def keys(self, low):
        h = np.arange(self.bands, dtype=np.uint64)
        for col in low.reshape(self.bands, self.rows).T:
            h = scramble(h * np.uint64(0x9E3779B97F4A7C15) + col)
        return h.view(np.int64)

    @staticmethod
    def sketch(low):
        mixed = scramble(low[:SKETCH])  # the high bits of a minimum over many values are zero
        planes = [(mixed >> np.uint64(p)) & np.uint64(1) for p in range(PLANES)]
        return np.packbits(np.concatenate(planes).astype(np.uint8)).view(np.int64)


def _features(k, bands, rows):
    def run(batches):
        hashes, mh = WordHashes(), MinHash(bands, rows)
        for batch in batches:
            n, dig, keys, sk = [], [], [], []
            for text in batch.column(2).to_pylist():
                g = shingles(text, k, hashes)
                n.append(len(g))
                dig.append(digest(g))
                if len(g):
                    low = mh.minima(g)
                    keys.append(mh.keys(low))
                    sk.append(mh.sketch(low))
                else:
                    keys.append(np.empty(0, np.int64))
                    sk.append(np.zeros(len(S), np.int64))
            if not n:
                continue
            dig, sk = np.array(dig), np.array(sk)
            offsets = np.r_[0, np.cumsum([len(x) for x in keys])].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(dig[:, 0]), pa.array(dig[:, 1]),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))]
                + [pa.array(np.ascontiguousarray(sk[:, i])) for i in range(len(S))],
                names=["doc_id", "row_key", "n_shingles", "d1", "d2", "keys", *S])
    return run


def _sets(k):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, out = [], []
            for i, d1, d2, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                g = shingles(text, k, hashes)
                if tuple(digest(g)) == (d1, d2):
                    ids.append(i)
                    out.append(g.view(np.int64))
            if ids:
                offsets = np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(np.concatenate(out)))], names=["id", "grams"])
    return run


def _likely(a, b, percent):
    """The sizes and the sketches allow the threshold."""
    size = (100 * F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) >= percent * F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n")))
    half = len(S) // PLANES
    bits = [F.bit_count(F.expr(" | ".join(f"({a}.{S[p * half + i]} ^ {b}.{S[p * half + i]})" for p in range(PLANES)))) for i in range(half)]
    different = bits[0]
    for x in bits[1:]:
        different = different + x
    return size & (different <= MAX_DIFFERENT)


def _pairs(df):
    return df.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")).distinct()


def _confirm(pairs, sets, percent):
    """Pairs whose full sets reach the threshold."""
    j = pairs.join(sets.select(F.col("id").alias("u"), F.col("grams").alias("gu")), "u")
    j = j.join(sets.select(F.col("id").alias("v"), F.col("grams").alias("gv")), "v")
    j = j.select("u", "v", (F.size("gu") + F.size("gv")).alias("both"), F.size(F.array_intersect("gu", "gv")).alias("common"))
    return j.where(100 * F.col("common") >= percent * (F.col("both") - F.col("common"))).select("u", "v")


def _meet_by_prefix(members, sets, percent):
    """Pairs (a, b) of different components with a common shingle early enough in both, the rarest shingles first."""
    grams = members.select("id").join(sets, "id").select("id", F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    ordered = grams.join(often, "gram").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("g"))
    prefix = F.slice("g", 1, F.size("g") - F.ceil(F.size("g") * F.lit(percent / 100) - F.lit(1e-9)).cast("int") + 1)
    early = ordered.select("id", F.posexplode(prefix).alias("at", "e")).where("e.often > 1").select("id", "at", "e.gram")
    early = materialise(early.join(members, "id"))
    sizes = early.groupBy("gram", "component").agg(F.count("*").alias("members"))
    large = sizes.groupBy("gram").agg(F.max_by("component", "members").alias("large"), F.count("*").alias("kinds")).where("kinds > 1")
    asks = early.join(large.drop("kinds"), "gram").where(F.col("component") != F.col("large"))
    need = F.ceil((F.col("a.n") + F.col("b.n")) * F.lit(percent / (100 + percent)) - F.lit(1e-9))
    reach = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= need
    once = (F.col("b.component") == F.col("a.large")) | (F.col("a.id") < F.col("b.id"))
    return asks.alias("a").join(early.alias("b"), "gram").where(
        (F.col("a.component") != F.col("b.component")) & once & reach & _likely("a", "b", percent))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, row_key, n_shingles, component_id (the smallest doc_id that links of at least
    ``percent`` of shared shingles reach, its own included) and group (a number of the component; null without words).

    Texts without words (null, empty, blank) have an empty set and are linked with nothing, not even with each other.
    Rows that share a doc_id are compared as rows; a null doc_id is never the smallest unless all of its component are
    null. Repeated rows are copies like others. Extra columns are ignored; empty tables give an empty result.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), whole().alias("text"))
    feats = materialise(d.mapInArrow(_features(k, bands, rows), FEATURES))
    classes = feats.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("low"))
    c = classes.select(F.col("d1").alias("_1"), F.col("d2").alias("_2"), "low")
    first = feats.where("n_shingles > 0").join(c, (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")) & F.col("doc_id").eqNullSafe(F.col("low")))
    nodes = materialise(first.select(F.monotonically_increasing_id().alias("id"), "doc_id", "d1", "d2",
                                     F.col("n_shingles").alias("n"), "keys", *S))
    keyed = nodes.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    own_keys = keyed.join(shared, "key").groupBy("id").agg(F.collect_list("key").alias("keys"), F.sum("members").alias("score"))
    buckets = own_keys.join(nodes.select("id", "n", *S), "id")
    buckets = materialise(buckets.select("id", "n", "score", *S, F.explode("keys").alias("key")))

    members = buckets.select("id").distinct().join(nodes.select("id", "doc_id", "d1", "d2"), "id")
    members = members.select("id", F.col("doc_id").alias("_doc"), "d1", "d2")
    texts = d.join(members, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("id", "d1", "d2", "text")
    sets = materialise(texts.mapInArrow(_sets(k), "id long, grams array<long>").dropDuplicates(["id"]))

    links, comp = None, None
    for rnd in range(3):
        b = buckets if comp is None else buckets.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        if comp is None:
            b = b.withColumn("component", F.col("id"))
        else:
            b = materialise(b)
            open_keys = b.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
            if not open_keys.take(1):
                break
            b = b.join(open_keys, "key")
        if rnd < 2:
            rank = F.struct("score", "id") if rnd == 0 else F.xxhash64("key", "id")
            centre = b.groupBy("key").agg(F.max_by(F.struct("id", "n", "component", *S), rank).alias("c")).select("key", "c.*")
            j = b.alias("a").join(centre.alias("b"), "key").where((F.col("a.component") != F.col("b.component")) & _likely("a", "b", percent))
        else:
            j = _meet_by_prefix(b.select("id", "component", "n", *S).distinct(), sets, percent)
        found = _confirm(_pairs(j), sets, percent)
        links = materialise(found if links is None else links.unionByName(found))
        comp = materialise(components(links))

    named = nodes.select("id", "doc_id", "d1", "d2").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = materialise(named)
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = named.join(lowest, "component").select(F.col("d1").alias("_1"), F.col("d2").alias("_2"), "component_id",
                                                      F.col("component").alias("group")).dropDuplicates(["_1", "_2"])
    own = feats.select("doc_id", "row_key", "n_shingles", "d1", "d2")
    j = own.join(found, (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")) & (F.col("n_shingles") > 0), "left")
    return j.select("doc_id", "row_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "group")
