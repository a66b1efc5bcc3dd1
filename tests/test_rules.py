"""Rule resolution, matching and outcomes on small fixtures."""
import itertools

from helpers import rows
from pyspark.sql import functions as F

from assetlake.functions import classify as C
from assetlake.functions import keys, sizes, text
from assetlake.functions.rules import rule
from assetlake.operators import assets as A
from assetlake.operators import ordering as W
from assetlake.operators import outcomes as O
from assetlake.operators import presets as P
from assetlake.operators import resolve as R
from assetlake.operators import summaries as S
from assetlake.schemas import RULE


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def L(*names):
    return F.array(*[F.lit(n) for n in names])


def test_class_priority_and_risk(spark):
    assert one(spark, C.classify(L("MainTex", "AlphaMask")), C.classify(L("EmissionMask")), C.classify(L("BUMPmap")),
               C.classify(F.array().cast("array<string>")), C.is_risky(L("ParallaxMap")), C.is_risky(L("alphamask")),
               C.is_risky(L("AlphaMask"))) == ("mask", "mask", "normal", "other", False, False, True)


def test_material_suffix(spark):
    names = ["a.MECopy", "a.mecopy12", ".MECopy1", "a.MECopyX", "a.MECopy1.MECopy2", "a\n.MECopy3", "a.MECopy1\n", None]
    got = one(spark, *[text.norm_material(F.lit(n).cast("string")) for n in names])
    assert got == ("a", "a", ".MECopy1", "a.MECopyX", "a.MECopy1", "a\n", "a.MECopy1\n", "")


def test_half_to_even_and_minimum_edge(spark):
    t = sizes.target_size(F.lit(2048), F.lit(5), F.lit(1024))
    u = sizes.target_size(F.lit(2000), F.lit(7), F.lit(1000))
    w = sizes.target_size(F.lit(4096), F.lit(1), F.lit(64))
    assert one(spark, t["height"], u["height"], w["height"], w["width"]) == (2, 4, 1, 64)


def test_owner_tokens_and_masks(spark):
    got = one(spark, *[keys.owner_from_token(F.lit(s)) for s in ("acc3", "acc_12", "1003", "4", "sh", "outer", "zzz", "bra")])
    assert got == (1003, 1012, 1003, 4, 3, 8, -1, 2)
    assert one(spark, keys.group_mask(L("body", "g3", "31", "-1")), keys.group_mask(L("all")), keys.group_mask(L(""))) == (9, 0, 0)
    none = F.array().cast("array<int>")
    assert one(spark, keys.in_mask(F.array(F.lit(0), F.lit(3)), F.lit(9)), keys.in_mask(F.array(F.lit(31)), F.lit(-1)),
               keys.in_mask(none, F.lit(1))) == (True, False, True)


def test_display_numbers_round_trip(spark):
    assert one(spark, text.human_bytes(F.lit(1023)), text.human_bytes(F.lit(1152)), text.human_bytes(F.lit(5 * 1024 ** 4))) == (
        "1023 B", "1.13 KB", "5120.00 GB")
    assert one(spark, text.parse_display_number(F.lit("1 x / 2.19 MB"), "own"), text.parse_display_number(F.lit("4096px"), "dim"),
               text.parse_display_number(F.lit("—"), "size"), text.parse_display_number(F.lit("12"), "count")) == (2296381, 4096, 0, 12)


def test_translation_takes_longest_match_first(spark):
    t = {"a": "1", "ab": "2", "abc": "3", "x.y": "dot"}
    got = one(spark, *[text.translate_terms(F.lit(s), t, [("n([0-9]+)", "No ")]) for s in ("abcab-a", "x.y xzy", "qq", "n12a")])
    assert got == ("32-1", "dot xzy", "qq", "No 121")
    many = spark.range(20001).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(";")).alias("source"), F.col("id").cast("string").alias("target"))
    texts = spark.createDataFrame([(1, "w20000; and w1;w19999;w7"), (2, None), (3, ""), (4, "none")], "k int, t string")
    assert {r.k: r.translated for r in text.translate_glossary(texts, "t", many).collect()} == {1: "20000 and 119999w7", 2: None, 3: "", 4: "none"}
    assert one(spark, text.strip_tail(F.lit("上衣 top")), text.strip_tail(F.lit("见 上衣 top!")), text.has_cjk(F.lit("abc"))) == ("top", "top!", False)


def test_owner_merge_matrix(spark):
    """All pairs of rules of two owners against a brute-force merge."""
    opts = [None] + [(f, s) for f in ("keep", "png", "auto", "jpeg") for s in (0, 512, 1024)]
    rank = {"keep": 0, "png": 1, "auto": 2, "jpeg": 3}
    pairs = list(itertools.product(opts, opts))
    owners = spark.createDataFrame([(n, 1, 2 * n + k) for n in range(len(pairs)) for k in (0, 1)],
                                   "container_id int, asset_id int, owner_key int")
    rules = spark.createDataFrame([(2 * n + k, (o[0], o[1], None, None, None, 2)) for n, p in enumerate(pairs)
                                   for k, o in enumerate(p) if o], f"owner_key int, rule {RULE}")
    got = {r.container_id: (r.owner_rule and (r.owner_rule.format, r.owner_rule.size, r.owner_rule.up))
           for r in A.merge_owner_rules(owners, rules).collect()}
    for n, p in enumerate(pairs):
        want = None
        if all(o and o[0] != "keep" for o in p):
            want = (min((o[0] for o in p), key=rank.get), max(o[1] for o in p), None)
        assert got[n] == want, p


def test_owner_merge_other_fields(spark):
    owners = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (1, 2, 0), (1, 3, 2), (1, 3, 0)], "container_id int, asset_id int, owner_key int")
    rules = spark.createDataFrame([(0, ("auto", 5, 80, "cas", 1, 4)), (1, ("png", 9, 0, "cas", 0, 2)), (2, ("png", 9, None, None, 1, None))],
                                  f"owner_key int, rule {RULE}")
    got = {r.asset_id: tuple(r.owner_rule) for r in A.merge_owner_rules(owners, rules).collect()}
    assert got[1] == ("png", 9, 0, "cas", None, None)      # explicit 0 is a value, differing gray follows, two owners drop up
    assert got[2] == ("auto", 5, 80, "cas", 1, 4)          # a single owner keeps everything
    assert got[3] == ("png", 9, None, None, 1, None)       # one owner follows -> the result follows


def test_precedence_layers(spark):
    assets = spark.createDataFrame([(1, i) for i in range(1, 5)] + [(2, 1)], "container_id int, asset_id int")
    b = spark.createDataFrame([(1, 1, 1, 0, 0, "MainTex"), (1, 2, 1, 1, 0, "BumpMap"), (1, 3, 1, 2, 0, "MainTex"), (2, 1, 1, 0, 0, "MainTex")],
                              "container_id int, asset_id int, obj_type int, slot int, coord_idx int, property string")
    b = A.with_owner_key(b)
    orules = spark.createDataFrame([(0, ("png", 256, None, None, None, None)), (1, ("keep", 0, None, None, None, None))], f"owner_key int, rule {RULE}")
    hits = spark.createDataFrame([(1, 2, ("jpeg", 64, None, None, None, None)), (2, 1, ("jpeg", 64, None, None, None, None))],
                                 f"container_id int, asset_id int, asset_rule {RULE}")
    routes = spark.createDataFrame([(1, "apply", None), (2, "uniform", ("auto", 99, 1, None, None, 2))], f"container_id int, action string, uniform {RULE}")
    out = R.resolve_rules(assets, b, R.builtin_plans(spark).where("plan_id = 'quality'").drop("plan_id"), owner_rules=orules,
                          asset_hits=hits, routes=routes)
    got = {(r.container_id, r.asset_id): (r.rule.format, r.rule.size, r.keep, r.source, r.reason) for r in out.collect()}
    assert got[1, 1] == ("png", 256, False, "owner", None)
    assert got[1, 2] == ("jpeg", 64, False, "preset", "single asset rule")
    assert got[1, 3][2:] == (True, "owner", "left alone by 2")
    assert got[1, 4][2:] == (True, "owner", "no owner")
    assert got[2, 1] == ("auto", 99, False, "uniform", "container does not match the preset")


def test_scores_of_identical_partial_disjoint_empty(spark):
    mk = lambda n: [f"s{i}" for i in range(n)]
    cont = spark.createDataFrame([("same", s) for s in mk(83)] + [("part", s) for s in mk(59)] + [("none", "zz")], "container_id string, sig string")
    pre = spark.createDataFrame([(s,) for s in mk(83)], "sig string")
    names = spark.createDataFrame([("same", "clothes"), ("part", "clothes"), ("none", "clothes"), ("kind", "chara")], "container_id string, kind string")
    sc = P.score_against(names, cont, pre)
    assert dict(rows(sc, "container_id", "score")) == {"same": 1.0, "part": 59 / 83, "none": 0.0, "kind": 0.0}
    empty = P.score_against(names, cont, pre.where("false"))
    assert {r.score for r in empty.collect()} == {1.0}
    act = dict(rows(P.route_containers(sc, "clothes", 0.5), "container_id", "action"))
    assert act == {"same": "apply", "part": "apply", "none": "skip", "kind": "skip"}
    act = dict(rows(P.route_containers(sc, "clothes", 0.8, True, "png", True), "container_id", "action"))
    assert act == {"same": "apply", "part": "uniform", "none": "uniform", "kind": "copy"}
    assert dict(rows(P.route_containers(sc, "chara"), "container_id", "rc"))["kind"] == 0


def test_prefix_filter_equals_brute_force(spark):
    import random
    rnd = random.Random(3)
    sets = {i: {f"s{min(int(rnd.expovariate(0.12)), 40)}" for _ in range(rnd.randint(1, 25))} for i in range(60)}
    sets[60] = set(sets[7])
    sets[61] = set(sets[7])
    place = {i: (i % 3, "k" if i % 5 else "c") for i in sets}
    cs = spark.createDataFrame([(i, s) for i, ss in sets.items() for s in ss], "container_id int, sig string")
    c = spark.createDataFrame([(i, *p) for i, p in place.items()], "container_id int, rel_dir int, kind string")
    pre = {100 + i: sets[i] | {"only here"} if i % 4 == 0 else sets[i] for i in range(0, 20)}
    p = spark.createDataFrame([(k, *place[k - 100]) for k in pre], "preset_id int, rel_dir int, kind string")
    ps = spark.createDataFrame([(k, s) for k, ss in pre.items() for s in ss], "preset_id int, sig string")
    for t in (0.3, 0.5, 1.0):
        got = {(r.preset_id, r.container_id): r.n_hits for r in P.similar_containers(p, ps, c, cs, t).collect()}
        want = {(k, i): len(ss & sets[i]) for k, ss in pre.items() for i in sets
                if place[i] == place[k - 100] and ss & sets[i] and len(ss & sets[i]) / len(ss) >= t - 1e-12}
        assert got == want


def test_asset_rule_match_by_id_needs_missing_signatures(spark):
    assets = spark.createDataFrame([(1, 5), (1, 6), (1, 7)], "container_id int, asset_id int")
    sigs = spark.createDataFrame([(1, 5, "a"), (1, 6, "b")], "container_id int, asset_id int, sig string")
    ar = spark.createDataFrame([("p", 0, "5", ["b"], ("png", 1, 9, None, None, 2)), ("p", 1, "7", ["x"], ("jpeg", 8, None, None, None, None)),
                                ("p", 2, "6", [], ("keep", 4, None, None, None, None)), ("p", 3, "99", ["a", "q"], ("auto", 2, None, None, None, None)),
                                ("p", 4, "98", ["nope"], ("auto", 2, None, None, None, None))],
                               f"preset_id string, rule_no int, asset_id string, sigs array<string>, rule {RULE}")
    hits = P.match_asset_rules(assets, sigs, ar)
    assert rows(hits, "asset_id", "rule_no") == [(5, 3), (6, 0), (6, 2), (7, 1)]
    a, b = P.merge_preset_hits(hits, ar).drop("n_hits"), P.preset_asset_rules(assets, sigs, ar)
    assert rows(a) == rows(b)
    got = {r.asset_id: tuple(r.asset_rule) for r in a.collect()}
    assert got[6] == ("keep", 4, None, None, None, None)   # least rank, largest size, the rest follows again
    runs = spark.createDataFrame([(1, "p")], "container_id int, preset_id string")
    assert rows(P.missed_rules(ar, hits, sigs, runs), "rule_no") == [(4,)]
    assert rows(P.apply_preset_assets(assets, sigs, ar), "asset_id", "rule_no") == [(5, 3), (6, 2), (7, 1)]   # 5: id and sig, last wins
    assert tuple(P.preset_counts(ar, sigs, assets).first())[2:] == (5, 1)


def test_format_decision_and_protection(spark):
    d = spark.createDataFrame([
        (1, "maintex", False, True, False, False, ("auto", 0, None, None, None, None)),
        (2, "maintex", True, True, False, False, ("auto", 512, None, None, None, None)),
        (3, "matcap", False, False, True, True, ("auto", 512, None, None, None, None)),
        (4, "maintex", False, False, True, False, ("jpeg", 512, None, None, None, None)),
        (5, "maintex", False, True, False, True, None)],
        f"id int, class string, risky boolean, flat_alpha boolean, circle_only boolean, exclusive boolean, rule {RULE}")
    d = d.withColumns({"keep": F.lit(False), "width": F.lit(2048), "height": F.lit(100)})
    f = R.protect_exclusive(R.decide_format(d, "png", 700, 300))
    got = {r.id: (r.use_jpeg, r.auto_mode, r.cap, r.protected) for r in f.collect()}
    assert got == {1: (True, True, 2048, False), 2: (False, True, 512, False), 3: (True, True, 4096, True),
                   4: (True, False, 512, False), 5: (False, False, 4096, True)}
    s = {r.id: (r.up_factor, r.up_reason) for r in R.plan_sizes(f, 2).collect()}
    assert s[1] == (0, "cap") and s[3] == (2, None)        # the raised cap makes room


def test_outcome_labels(spark):
    cols = "id int, raw_bytes long, png_bytes long, jpeg_bytes long, use_jpeg boolean, auto_mode boolean, upscaled boolean, raw_opt_bytes long, png_opt_bytes long, jpeg_opt_bytes long, raw_fmt string"
    d = spark.createDataFrame([
        (1, 100, 80, 70, True, True, False, None, 75, 60, "PNG"), (2, 100, 80, 80, True, True, False, None, 79, None, "PNG"),
        (3, 100, 120, 110, True, True, False, 90, None, None, "PNG"), (4, 100, 120, 110, True, False, False, 100, None, None, "JPEG"),
        (5, 100, 400, 300, True, True, True, 1, None, None, "PNG"), (6, 100, 120, None, False, False, False, 99, None, None, "JPEG")], cols)
    got = {r.id: (r.fmt, r.out_bytes, r.packed) for r in O.choose_candidate(d).collect()}
    assert got == {1: ("JPEG", 60, False), 2: ("PNG", 79, True), 3: ("PNG*", 90, True), 4: ("orig", 100, False),
                   5: ("JPEG", 300, False), 6: ("JPEG*", 99, False)}


def test_batch_counts(spark):
    co = spark.createDataFrame([
        (1, 0, False, True, "", 100, 10), (2, 0, False, False, "", 100, 50), (3, 3, False, True, "", 5, 5), (4, 6, False, True, "why", 5, 5),
        (5, 0, True, True, "", 7, 7), (6, 4, False, True, "", 9, 9), (7, None, False, False, "", 9, 9)],
        "container_id int, rc int, copied boolean, verified boolean, reason string, bytes_before long, bytes_after long")
    r = S.batch_summary(co).first()
    assert (r.n_ok, r.n_skipped, r.n_failed, r.n_copied, r.bytes_before, r.bytes_after) == (1, 2, 3, 1, 200, 60)
    assert [x.container_id for x in S.batch_lists(co).orderBy("container_id").collect()] == [2, 3, 4, 6, 7]


def test_sorting_keeps_empty_last(spark):
    d = spark.createDataFrame([(0, "2.00 KB"), (1, "—"), (1003, "10 B"), (2004, "10 B"), (3, "1.00 MB"), (5, "")], "owner_key int, size string")
    order = lambda desc: [r.owner_key for r in W.sort_table(d, "size", "size", desc).collect()]
    assert order(True) == [3, 0, 1003, 2004, 1, 5] and order(False) == [1003, 2004, 0, 3, 1, 5]


def test_rank_within_one_hot_key(spark):
    d = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("k"), (F.col("id") * 7919 % 20011).alias("v"))
    got = W.rank_within(d, ["k"], ["v"], "rank", buckets=7)
    from pyspark.sql import Window
    want = d.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("v")))
    assert got.select("k", "v", "rank").exceptAll(want).count() == 0 and got.count() == 20000


def test_names_do_not_collide(spark):
    f = spark.createDataFrame([("d", "a", "1"), ("d", "a", "2"), ("d", "a", "3"), ("d", "a_2", "4"), ("e", "a", "5"), ("d", "b", "6")],
                              "rel_dir string, stem string, path string")
    e = spark.createDataFrame([("d", "b"), ("d", "a_7")], "rel_dir string, stem string")
    got = rows(W.dedupe_names(f, e), "rel_dir", "path", "out_stem")
    assert got == [("d", "1", "a"), ("d", "2", "a_8"), ("d", "3", "a_9"), ("d", "4", "a_2"), ("d", "6", "b_2"), ("e", "5", "a")]


def test_settings_absent_is_not_false(spark):
    d = spark.createDataFrame([(None, None, True), (None, False, True), (True, False, False)], "cli_x boolean, file_x boolean, default_x boolean")
    assert [r.x for r in d.select(R.merge_settings("cli_", "file_", "default_", fields=["x"])["x"].alias("x")).collect()] == [True, False, True]


def test_bulk_edit_and_expansion(spark):
    r = spark.createDataFrame([(100001, True, ("keep", 0, None, None, None, None)), (200001, False, ("png", 5, 9, None, None, None))],
                              f"owner_key int, enabled boolean, rule {RULE}")
    got = {x.owner_key: tuple(x.rule) for x in R.apply_uniform(r, "enabled", values={"format": "auto", "sharpen_pct": None}, up=2).collect()}
    assert got == {100001: ("auto", 0, None, None, None, 2), 200001: ("png", 5, 9, None, None, None)}
    assert rule("png", 1) is not None
