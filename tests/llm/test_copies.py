"""Near-dedup, components and repeated phrases against brute force."""
import random
from collections import Counter

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlake.llm import components, near_dedup, phrase_dedup
from assetlake.llm.common import row_key


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7), (8, 9), (9, 8)]
    got = dict(components.components(spark.createDataFrame(edges + [(None, 1)], "u long, v long")).collect())
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, rows, none, k):
    got = near_dedup.near_duplicates(docs, k=k).collect()
    want, _ = cases.components(rows, k)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want)
    assert len({w[2] for w in want}) < len({w[0] for w in want})
    assert near_dedup.near_duplicates(none, k=k).count() == 0


def test_large_group_of_near_copies(spark):
    """One group whose members are mostly not alike in pairs: links must survive the rounds."""
    r, v = random.Random(8), cases.vocabulary(900)
    base = [r.choice(v) for _ in range(90)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(7)):
            w[r.randrange(90)] = r.choice(v)
        rows.append((i, " ".join(w), "s"))
    got = near_dedup.near_duplicates(cases.frame(spark, rows), k=4).collect()
    want, _ = cases.components(rows, 4)
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == Counter(want)
    assert 1 < len({w[2] for w in want}) < 100


def test_minhash_estimates():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 1000, np.uint64)
    b = np.concatenate([a[:900], r.integers(0, 2**63, 100, np.uint64)])
    m = near_dedup.MinHash()
    x, y = m.minima(a), m.minima(b)
    assert abs((x == y).mean() - 900 / 1100) < 0.1
    def different(u, v):
        d = m.sketch(m.minima(u)) ^ m.sketch(m.minima(v))
        return sum(int(w).bit_count() for w in (d[:len(d) // 2] | d[len(d) // 2:]).view(np.uint64))

    assert 0 < different(a, b) <= near_dedup.MAX_DIFFERENT
    for n in (50, 200, 2000):  # disjoint sets fail the sketch test, pairs at the threshold of 0.8 pass it
        u, v, w = (r.integers(0, 2**63, n, np.uint64) for _ in range(3))
        assert different(u, v) > near_dedup.MAX_DIFFERENT
        k = n * 8 // 10
        assert different(np.r_[u[:k], v[:n // 10]], np.r_[u[:k], w[:n // 10]]) <= near_dedup.MAX_DIFFERENT


def digests(docs, **options):
    texts, removed = phrase_dedup.repeated_phrases(docs, **options)
    r = removed.select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_r"), "n_removed", F.sha2("kept", 256).alias("_s")).dropDuplicates(["_d", "_r"])
    j = texts.join(r, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row_key") == F.col("_r")), "left")
    return Counter(map(tuple, j.select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))),
                                       F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_s", "sha"))).collect()))


@pytest.mark.parametrize("group", [4096, 2])
def test_repeated_phrases(docs, rows, none, group):
    """With two segments a group nearly every seed is dealt over salts."""
    keys = dict(docs.select("text", row_key()).collect())
    want = cases.phrases(rows, key=keys.get)
    assert digests(docs, group=group) == Counter(want)
    assert sum(w[2] for w in want) > 300
    assert not digests(none)


def test_low_variety(spark):
    """Texts of few different words, where every window has the same seed."""
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("ab" if i % 3 else "a") for _ in range(r.randint(15, 90))), "s") for i in range(40)]
    df = cases.frame(spark, rows)
    keys = dict(df.select("text", row_key()).collect())
    assert digests(df) == Counter(cases.phrases(rows, key=keys.get))
