"""Ranks by prefix sums, places, and glossary translation by prefix and term, against brute force."""
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from assetlake.functions import glossary, text
from assetlake.operators import ordering as W
from assetlake.registry.core import with_place
from test_streaming_and_scale import plan


def test_ranks_of_any_order(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", None, "a", "b"]), r.choice([None, "", "https://x/" + str(r.randrange(40)), "é"]), r.choice([None, 1.5, -2.0]), i) for i in range(3000)]
    rows += rows[:50]  # repeated rows
    d = spark.createDataFrame(rows, "k string, path string, v double, id long").repartition(5)
    for by, order, brute in ((["k"], ["path", F.col("v")], ["path", "v"]), ([], [-F.col("v"), "path"], [F.desc("v"), "path"])):
        got = W.rank_within(d, by, order, "rank", buckets=9)
        if not by:
            order = [(-F.col("v")).asc(), "path"]
            brute = order
        want = d.withColumn("want", F.rank().over(Window.partitionBy(*by).orderBy(*brute)))
        top = want.groupBy(*d.columns).agg(F.min("want").alias("want"), F.count("*").alias("n"))
        j = got.join(top, [got[c].eqNullSafe(top[c]) for c in d.columns]).select("rank", "want", got["k"])
        ranks = {}
        for x in j.collect():
            assert x.rank >= x.want
            ranks.setdefault(x.k if by else "", []).append(x.rank)
        assert all(sorted(set(v)) == list(range(1, max(v) + 1)) for v in ranks.values()) and sum(map(max, ranks.values())) == 3050
    assert W.rank_within(d.limit(0), ["k"], ["path"]).count() == 0


def test_slices_share_a_hot_key_and_nothing_is_written(spark):
    d = spark.range(100000).select(F.lit("one").alias("k"), (F.col("id") * 7919 % 100003).alias("v"))
    key = F.struct("k", F.col("v").alias("o0"), F.xxhash64("k", "v").alias("tie"))
    sizes = [r[1] for r in W._sliced(d, key, 8).groupBy("_slice").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 3 * 100000 / len(sizes)
    ranked = W.rank_within(d, ["k"], ["v"], buckets=8)
    assert "FileScan" not in plan(ranked) and ranked.agg(F.count_distinct("rank"), F.max("rank")).first() == (100000, 100000)


def test_places_need_no_single_task(spark):
    d = spark.range(5000).select((F.col("id") * 37 % 1000).alias("v")).orderBy(F.desc("v"))
    got = {r.v: r.place for r in with_place(d, "v").collect()}
    assert got == {v: 1 + 5 * (999 - v) for v in range(1000)}


def brute(t, terms):
    out, i = "", 0
    while i < len(t):
        best = max((s for s in terms if s and t.startswith(s, i)), key=len, default=None)
        out, i = (out + terms[best], i + len(best)) if best else (out + t[i], i + 1)
    return out


def test_glossary_by_prefix_and_term(spark):
    r = random.Random(6)
    letters = "abcé上"
    terms = {"".join(r.choice(letters) for _ in range(r.choice([1, 2, 3, 4, 5, 7, 9]))): f"<{k}>" for k in range(60)}
    terms.pop("a", None)
    terms["abca"], terms["b"] = "", "$1\\"
    texts = [None, "", "a", *terms, *["".join(r.choice(letters + "\n") for _ in range(n)) for n in (1, 2, 3, 4, 5, 50, 700, 3000)]]
    rows = [(i % 3, t) for i, t in enumerate(texts)] + [(0, "abcab"), (0, "abcab"), (1, "abcab")]
    d = spark.createDataFrame(rows, "k int, t string")
    g = spark.createDataFrame([*terms.items(), ("", "never"), (None, "never")], "source string, target string")
    got = sorted(((x.k, x.t, x.translated) for x in text.translate_glossary(d, "t", g).collect()), key=str)
    assert got == sorted(((k, t, t if t is None else brute(t, terms)) for k, t in rows), key=str)
    assert text.translate_glossary(d, "t", g.limit(0)).where(F.col("translated").eqNullSafe(F.col("t"))).count() == len(rows)


def test_glossary_on_a_long_text(spark):
    unit = "the quick brown fox "
    d = spark.createDataFrame([(unit * 5000,)], "t string")
    g = spark.createDataFrame([("quick", "slow"), ("fox", "dog"), ("brown f", "no"), ("brown fox q", "no")], "source string, target string")
    assert text.translate_glossary(d, "t", g).first().translated == "the slow noox " * 5000


def test_a_small_glossary_moves_nothing(spark):
    d = spark.createDataFrame([("the fox " * 3,), (None,), ("",)], "t string")
    g = spark.createDataFrame([("the fox", "a dog"), ("the", "le"), ("x", None)], "source string, target string")
    out = text.translate_glossary(d, "t", g)
    assert "Exchange" not in plan(out)
    assert [r.translated for r in out.collect()] == ["a dog " * 3, None, ""]


@pytest.mark.parametrize("few", [3, 20, 2000])
def test_a_large_glossary_with_terms_of_every_text(spark, monkeypatch, few):
    monkeypatch.setattr(text, "FEW", few)
    r = random.Random(few)
    terms = {f"<{k}>": f"[{k}]" for k in range(3000)} | {"<": "?", "for": "4", " everywhere else": "!", "1": "one"}
    texts = [f"<{r.randrange(6000)}> for 1 everywhere else" + " <7>" * r.randrange(9) for _ in range(4000)]
    texts += [None, "", "nothing", "<" * 300, "x" * 63, "x" * 64, *["<12> and " * 50, "<12> and " * 50]]
    d = spark.createDataFrame(enumerate(texts), "k int, t string")
    g = spark.createDataFrame(terms.items(), "source string, target string")
    out = text.translate_glossary(d, "t", g)
    short = lambda t: brute(t, {s: terms[s] for s in set(re.findall("<[0-9]+>", t)) & set(terms)} | {k: terms[k] for k in ("<", "for", " everywhere else", "1")})
    assert {x.k: x.translated for x in out.collect()} == {k: t if t is None else short(t) for k, t in enumerate(texts)}
    # the term of one character is found by its head, and the join deals what every text asks for over salts
    assert "_salt" in plan(out)
    heads = glossary.Heads({"<": [1, 3]})
    assert glossary.asked("<a> <b> <a>", heads, 1) in (["<a>", "<b>"], ["<b>", "<a>"])


def test_long_texts_on_odd_rows(spark, tmp_path):
    import duckdb

    from assetlake.registry import ORACLES, QUERIES
    same = "the  fox and the owl  \n the fox"
    rows = [(1, "the fox and the owl"), (2, ""), (3, None), (4, same), (4, same), (5, "fox"), (5, None), (6, ""), (6, " the fox "), (7, " "), (8, ""), (8, ""),
            (None, "a the b"), (None, "a the b"), (9, "l'été the fox\t the fox ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("the fox",), ("the owl",), (None,)], "text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLES["P20_translate_long_texts"]).fetchall()
    got = [tuple(r) for r in QUERIES["P20_translate_long_texts"](spark, str(tmp_path)).select("doc_id", "digest").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) == 7


def test_slices_by_binary_search(spark):
    from bisect import bisect_right
    for n in (0, 1, 2, 7, 255, 300):
        bounds = list(range(0, 2 * n, 2))
        got = spark.range(-1, 2 * n + 1).select("id", W._place(F.lit(bounds).cast("array<bigint>"), F.col("id"), max(n, 1)).alias("s"))
        assert not got.schema["s"].nullable and all(r.s == bisect_right(bounds, r.id) for r in got.collect())


def test_order_assets_joins_once(spark, small):
    from assetlake.registry import QUERIES
    assert "lineitem.parquet" not in plan(QUERIES["W4_order_assets"](spark, small))  # ranks and sort read what was written
