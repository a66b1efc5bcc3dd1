"""Hard negatives, vector codes and license scans against plain Python."""
import hashlib
import random
from collections import Counter
from math import floor, isfinite

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlake.llm import hard_negatives as hn
from assetlake.llm import license_scan as ls
from assetlake.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, row string, id string, g string, code string, part string, vector string"


def table(spark, rows):
    """rows: (vec_id, vector, label). The other columns have names that operators use inside."""
    return spark.createDataFrame([(i, v, x, *(["x"] * 6)) for i, v, x in rows], SCHEMA)


def vectors(seed=5, n=150, width=16, kinds=4):
    r = random.Random(seed)
    f = lambda: float(np.float32(r.uniform(-1, 1)))
    middle = [[f() for _ in range(width)] for _ in range(kinds)]
    rows = []
    for i in range(n):
        k = r.randrange(kinds)
        rows.append((i, [float(np.float32(x + r.gauss(0, 0.3))) for x in middle[k]], k))
    rows += [(10, rows[10][1], 1), (10, rows[10][1], 1), (200, rows[10][1], 2), (201, rows[11][1], 1)]  # ties and repeated rows
    rows += [(300, None, 1), (301, [0.5, None] * 8, 1), (302, [float("nan")] * width, 1), (303, [float("inf")] * width, 2), (304, [0.5] * width, None),
             (305, [], 1), (306, [0.25] * 5, 2), (None, [0.5] * width, 1), (None, [0.5] * width, 2)]
    r.shuffle(rows)
    return rows


def whole_numbers(v, scale):
    return [floor(scale * float(x)) for x in v]


def usable(v):
    return v is not None and all(x is not None and isfinite(x) for x in v)


def brute_negatives(rows, every, positives=5, negatives=3):
    kept = [(i, whole_numbers(v, 256), x) for i, v, x in rows if x is not None and usable(v)]
    late = lambda i: (i is None, i or 0)
    out = []
    for a, (i, v, x) in enumerate(kept):
        if i is None or i % every:
            continue
        score = [sum(p * q for p, q in zip(v, w)) for _, w, _ in kept]
        order = sorted((b for b in range(len(kept)) if b != a), key=lambda b: (-score[b], late(kept[b][0])))
        for b in [b for b in order if kept[b][2] == x][:positives]:
            found = [c for c in order if kept[c][2] != x and 50 * score[b] <= 100 * score[c] <= 95 * score[b]][:negatives]
            out += [(i, kept[b][0], k, kept[c][0], score[b], score[c]) for k, c in enumerate(found, 1)]
    return Counter(out)


@pytest.mark.parametrize("group", [8192, 7])
def test_hard_negatives(spark, monkeypatch, group):
    monkeypatch.setattr(hn, "GROUP", group)  # several groups of anchors
    rows = vectors()
    df = table(spark, rows).repartition(3)
    got = hn.hard_negatives(df, F.col("vec_id") % 10 == 0)
    want = brute_negatives(rows, 10)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 60
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                          ("positive_score", "bigint"), ("negative_score", "bigint")]


def test_hard_negatives_without_rows_or_anchors(spark):
    assert hn.hard_negatives(table(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(table(spark, vectors(n=20)), F.lit(False)).count() == 0
    assert hn.hard_negatives(table(spark, [(0, [], 1), (10, [], 1), (3, [], 2)]), F.col("vec_id") % 10 == 0).collect()[0][3:] == (3, 0, 0)
    with pytest.raises(ValueError, match="55 bits"):
        hn.hard_negatives(table(spark, [(0, [1e30], 1)]), F.col("vec_id") == 0)


@pytest.mark.parametrize("width,largest", [(64, 256), (1, 1), (300, 10**5), (1000, 10**7)])
def test_products_are_exact_beyond_float32(width, largest):
    r = np.random.default_rng(width)
    a, b = (r.integers(-largest, largest + 1, (n, width)).astype(object) for n in (9, 13))
    a[0], b[0] = [largest] * width, [largest] * width
    b[1] = [-largest] * width
    want = a.dot(b.T)
    primes = hn.moduli(width * largest**2)
    got = hn.product(*(hn.Residues(x.astype(np.float64), primes) for x in (a, b)), primes)
    assert got.tolist() == want.tolist()
    for p in primes:  # the largest partial sum stays exact
        assert hn.slice_width(p) * ((p + 1) // 2 + 1) ** 2 <= hn.EXACT and hn.slice_width(p) >= 60


def brute_codes(rows, parts, entries, rounds, scale):
    kept = [(i, x, whole_numbers(v, scale)) for i, v, x in rows if usable(v)]
    width = -(-max((len(v) for *_, v in kept), default=0) // parts) * parts
    kept = [(i, x, v + [0] * (width - len(v))) for i, x, v in kept]
    w = width // parts
    cut = lambda v: [v[p * w:(p + 1) * w] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v)[p] for *_, v in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for k in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (gap(c, books[p][e]), e)) for p, c in enumerate(cut(v))] for *_, v in kept]  # noqa: B023
        if k == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v)[p] for (*_, v), c in zip(kept, codes) if c[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    rows = [(i, "".join(f"{e:02x}" for e in c), sum(gap(x, books[p][c[p]]) for p, x in enumerate(cut(v))), x) for (i, x, v), c in zip(kept, codes)]
    total = Counter()
    for _, _, e, x in rows:
        total[x] += e
    text = ",".join(str(x) for book in books for e in book for x in e)
    return Counter((i, c, e, total[x]) for i, c, e, x in rows), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("parts,entries,rounds", [(8, 16, 6), (4, 3, 2), (3, 40, 4)])
def test_vector_codes(spark, parts, entries, rounds):
    rows = [r for r in vectors(n=120)]
    coded, books = vc.vector_codes(table(spark, rows).repartition(3), parts=parts, entries=entries, rounds=rounds)
    got = Counter(tuple(r) for r in vc.with_label_errors(coded).select("vec_id", "code", "error", "label_error").collect())
    want, sha = brute_codes(rows, parts, entries, rounds, 4096)
    assert got == want and vc.codebooks_sha256(books) == sha


def test_vector_codes_of_few_or_no_vectors(spark):
    coded, books = vc.vector_codes(table(spark, []))
    assert coded.count() == 0 and books.shape[1] == 0 and vc.with_label_errors(coded).count() == 0
    coded, books = vc.vector_codes(table(spark, [(5, [0.5] * 8, None), (4, [0.5] * 8, 1), (1, [], 1)]))
    assert books.shape == (8, 3, 1) and {(r.vec_id, r.code, r.error) for r in coded.collect()} == {(5, "01" * 8, 0), (4, "01" * 8, 0), (1, "00" * 8, 0)}
    assert vc.vector_codes(table(spark, [(1, [], 1), (2, [], 1)]))[0].count() == 2
    with pytest.raises(ValueError, match="27 bits"):
        vc.vector_codes(table(spark, [(1, [1e9], 1)]))


def test_balls_skip_work_and_stay_exact():
    r = np.random.default_rng(2)
    entries = r.integers(-4000, 4000, (16, 8))
    entries[5] = entries[3]
    parts = entries[r.integers(0, 16, 3000)] + r.integers(-60, 60, (3000, 8))
    code = vc.Balls(entries).nearest(parts)[0]
    far = [int(max(vc.squared(parts[code == k], entries[k]), default=0)) for k in range(16)]
    balls = vc.Balls(entries, [int(x**0.5) + 1 for x in far])
    seen = []
    inner, vc.squared = vc.squared, lambda a, b: (seen.append(len(a)), inner(a, b))[1]
    try:
        got = balls.nearest(parts, code)
    finally:
        vc.squared = inner
    distance = ((parts[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    want = [min(range(16), key=lambda k: (row[k], k)) for row in distance]
    assert got[0].tolist() == want and got[1].tolist() == [row[k] for row, k in zip(distance, want)]
    assert sum(seen) < 2 * len(parts)  # of 16 entries
    wrong = (code + 1) % 16  # any entries to start from, without radii
    assert vc.Balls(entries).nearest(parts, wrong)[0].tolist() == want


def brute_licenses(text, templates, percent):
    words = [w.decode() for w in ls.words_of((text or "").encode())]
    base = sorted((i, label) for label, phrase in ls.PHRASES for p in [phrase.split()] for i in range(len(words)) if words[i:i + len(p)] == p)
    blocks = []
    for number, (label, t) in enumerate(templates):
        own = [w.decode() for w in ls.words_of((t or "").encode())]
        if not own:
            continue
        m = 1
        while m < len(own):
            m *= 2
        for a in range(0, len(words), m):
            common = len(set(own) & set(words[a:a + 2 * m]))
            if 100 * common >= percent * len(set(own)):
                blocks.append((label, number, a, min(len(words), a + 2 * m) - 1, common / len(set(own))))
    return len(words), base, sorted(blocks, key=repr)


def license_texts():
    r, v = random.Random(4), cases.vocabulary()
    texts = [None, "", " \n;;", "MIT license", "mit-LICENSE: apache license general, public license", "Mit licenses", "GENERAL PUBLIC LICENSE " * 3]
    for _, t in ls.TEMPLATES:
        w = t.split()
        for lost in (0, len(w) // 8, len(w) // 4):  # none, some and too many words are missing
            keep = sorted(r.sample(range(len(w)), len(w) - lost))
            texts.append(f"{cases.prose(r, v, r.choice([0, 3, 90]))}\n{' '.join(w[i] for i in keep)}\n{cases.prose(r, v, r.choice([0, 5, 400]))}")
    return texts + [cases.prose(r, v, 20000) + ls.TEMPLATES[3][1].upper() + cases.prose(r, v, 20000), "Licensed under CC BY-NC 4.0. " * 40]


@pytest.mark.parametrize("percent", [80, 35])
def test_license_blocks(spark, percent):
    texts = license_texts()
    templates = [*ls.TEMPLATES, ("none", " ;; "), ("null", None), ("short", "Licensed under")]
    df = cases.frame(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (None, texts[8], None)])
    got = ls.scan_licenses(df, templates, percent).collect()
    assert Counter(r.doc_id for r in got) == Counter([*range(len(texts)), 3, None])
    found = 0
    for r in got:
        text = texts[8 if r.doc_id is None else r.doc_id]
        n, base, blocks = brute_licenses(text, templates, percent)
        assert (r.n_words, [(b.word, b.label) for b in r.base]) == (n, base)
        assert sorted([(b.label, b.template, b.first_word, b.last_word, b.containment) for b in r.blocks], key=repr) == blocks
        for b in r.blocks:
            assert len(ls.words_of(text[b.start:b.end].encode())) == b.last_word - b.first_word + 1
        found += len(blocks)
    assert found > 25


def test_license_filters_and_order(spark, docs, none):
    assert ls.scan_licenses(none).count() == 0 and ls.scan_licenses(docs).count() == docs.count()
    assert ls.scan_licenses(docs, []).where(F.size("blocks") > 0).count() == 0
    assert ls.word_counts(cases.frame(spark, [(1, "a b A", "s"), (2, None, "s"), (2, "a", "s")]), [b"a", b"b", b"zz"]) == {b"a": 3, b"b": 1, b"zz": 0}
    known = ls.templates_of([("x", "the rare words of a notice"), ("y", "the of a")], 80)
    join = ls.Join(known, {w: i for i, w in enumerate([b"rare", b"notice", b"words", b"a", b"of", b"the"])})
    x = next(iter(join.by_step[8].values()))[0]
    assert {r for r in join.by_step[8]} == {0, 1} and x[0].need == 5  # only its two rarest words can begin a match
    assert list(join.blocks([b"the", b"of", b"a"] * 3))[0][0].label == "y"
