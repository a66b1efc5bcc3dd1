"""Containers and presets from synthetic bytes."""
import struct

from helpers import binding, container, mp, png, rows
from pyspark.sql import functions as F

from assetlake.operators.outcomes import verify
from assetlake.operators.summaries import classed
from assetlake.sources import containers as C
from assetlake.sources import corpus, rules_json, walk
from assetlake.sources.sniff import header_dims, sniff

HDR = b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 20 +X 40\n"


def inventory(spark, files):
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    return C.inventory(C.inventory_records(df))


def test_return_codes_of_bad_inputs(spark):
    good = container({1: png(width=7, height=9)}, [binding(1)])
    files = {
        "noise": b"\x01\x02random",
        "plain": png(),
        "no_key": container(),
        "key_off": container().replace(b"\xdf", b"\xdf") + bytes([0xa0 | 5]) + b"TextureDictionary" + mp(mp({1: b"x"})),
        "nil_value": container(raw_assets=b"\xc0"),
        "not_map": container(raw_assets=mp(mp([1, 2]))),
        "text_key": container({"a": b"x"}),
        "broken": container(raw_assets=mp(b"\xde\x00\x05\x01")),
        "good": good,
    }
    got = dict(rows(inventory(spark, files)["containers"], "container_id", "rc"))
    assert got == {"noise": 2, "plain": 3, "no_key": 3, "key_off": 3, "nil_value": 4, "not_map": 4, "text_key": 4,
                   "broken": 4, "good": 0}


def test_end_chunk_name_inside_image_data_and_long_keys(spark):
    image = png(idat=b"..IEND..\xaeB`\x82..")
    long_key = "com.example.plugin.with.a.very.long.key"
    b = container({3: png(width=5, height=6)}, [binding(3)], image=image) + mp(long_key) + mp("x")
    assert C.png_end(b) == len(image)
    assert C.find_key(b, long_key) > 0 and C.find_key(b, "TextureDictionary") > 0
    inv = inventory(spark, {"a": b})
    assert rows(inv["assets"], "asset_id", "fmt", "width", "height") == [(3, "PNG", 5, 6)]
    assert rows(inv["containers"], "kind", "name", "n_parts", "data_version") == [("clothes", "name", 3, "1.0")]


def test_one_unreadable_asset_does_not_spoil_the_container(spark):
    broken = b"\x00" * 8 + png(width=5, height=6)[8:]
    inv = inventory(spark, {"a": container({1: broken, 2: HDR, 3: png(width=2, height=3)}, [binding(1)])})
    assert rows(inv["assets"], "asset_id", "fmt") == [(1, "UNKNOWN"), (2, "HDR"), (3, "PNG")]
    assert rows(inv["containers"], "rc") == [(0,)]
    v = verify(inv["containers"], inv["assets"]).first()
    assert v.ok and v.n_hdr == 1 and v.n_other == 1


def test_verify_names_first_failure(spark):
    inv = inventory(spark, {"a": container({5: png(width=2, height=2), 7: b"\xff\xd8\xff\xe0\0\4ab", 9: b"\xff\xd8\xff\xe0\0\4ab"})})
    v = verify(inv["containers"], inv["assets"]).first()
    assert not v.ok and v.message == "asset 7 does not decode"


def test_properties_from_first_list_only_ownership_from_all(spark):
    b = container({1: png(), 2: png()}, [binding(1, "MainTex", 4)], chara=True,
                  extra_lists=[[binding(2, "MainTex", 1, coord=3), binding(1, "BumpMap", 1)]])
    inv = inventory(spark, {"c": b})
    from assetlake.operators.assets import with_owner_key
    bind = with_owner_key(inv["bindings"], grouped=True)
    assert rows(bind, "asset_id", "list_no", "owner_key") == [(1, 0, 102000), (1, 1, 200000), (2, 1, 500000)]
    assert rows(classed(inv["assets"], bind), "asset_id", "class") == [(1, "maintex"), (2, "other")]


def test_plain_container_reads_first_list_only(spark):
    b = container({1: png()}, [binding(1)], extra_lists=[[binding(1, slot=5)]])
    assert rows(inventory(spark, {"c": b})["bindings"], "slot") == [(0,)]


def test_unsigned_64_bit_wraps_and_defaults(spark):
    assert C.read_value(b"\xcf" + b"\xff" * 8, 0)[0] == -1
    assert C.read_value(b"\xc2", 0)[0] is False
    inv = inventory(spark, {"c": container({1: png()}, [{"TexID": 1, "Slot": "x"}, {"Property": "p"}])})
    assert rows(inv["bindings"], "obj_type", "slot", "material", "property") == [(1, 0, "", None)]


def test_jpeg_and_hdr_dims_agree_with_columns(spark):
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc2\x00\x0b\x08" + struct.pack(">HH", 30, 50) + b"\x01\x01\x11\x00"
    inv = inventory(spark, {"a": container({1: jpg, 2: HDR, 3: png(width=300, height=2)})})
    assert rows(inv["assets"], "asset_id", "width", "height") == [(1, 50, 30), (2, 40, 20), (3, 300, 2)]
    many = b"#?RADIANCE\n" + b"K=V\n" * 70 + b"\n-Y 1 +X 2\n"
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(
        [HDR, png(width=300, height=2), many, b"\x89PN", b"\x89PNG1234", b"\xff\xd8\xff", b"\xff\xd8\xff\x00", b"#?RGBE    x", b"v/1\x01"])],
        "i int, c binary")
    d = header_dims(F.col("c"))
    got = df.select("i", sniff(F.col("c")), d["width"], d["height"]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("HDR", 40, 20), ("PNG", 300, 2), ("HDR", 0, 0), ("UNKNOWN", 0, 0), ("UNKNOWN", 0, 0), ("UNKNOWN", 0, 0),
        ("JPEG", 0, 0), ("HDR", 0, 0), ("EXR", 0, 0)]


def test_hdr_header_lines_of_any_length(spark):
    long = b"#?RADIANCE\nSOFTWARE=" + b"x" * 70000 + b"\n\n-Y 9 +X 5" + b" " * 2000 + b"\npixels"
    d = header_dims(F.col("c"))
    got = spark.createDataFrame([(bytearray(long),)], "c binary").select(d["width"], d["height"]).first()
    assert tuple(got) == (5, 9)


def test_inventory_of_hdr_header_lines_of_any_length(spark):
    long = b"#?RADIANCE\nSOFTWARE=" + b"x" * 70000 + b"\n\n-Y 9 +X 5\npixels"
    inv = inventory(spark, {"a": container({1: long, 2: HDR})})
    assert rows(inv["assets"], "asset_id", "width", "height") == [(1, 5, 9), (2, 40, 20)]


def test_presets_from_trailer_and_text(spark):
    body = b'{"source": "s", "parts": {"100003": {"format": "png", "size": "big"}, "x": {}}, "minMatch": 0.25}'
    mark = b"AssetPreset1"
    files = {
        "a/[preset]One_x.png": png() + mark + struct.pack("<i", len(body)) + body,
        "a/[preset]two.json": b'{"name": "Shown", "cardType": "clothes"}',
        "a/none.png": png(),
        "a/short.png": png() + mark + struct.pack("<i", len(body) + 9) + body,
        "a/junk.json": b"{not json",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    p = rules_json.read_presets(C.preset_texts(df, mark.decode()))
    assert rows(p["presets"], "preset_id", "kind", "min_match") == [
        ("a/[preset]One_x.png", "chara", 0.25), ("a/[preset]two.json", "clothes", 0.5)]
    assert rows(p["owner_rules"], "owner_key", "rule.format", "rule.size", "rule.sharpen_pct") == [(100003, "png", 0, None)]
    assert [r.name for r in rules_json.preset_catalog(p["presets"]).collect()] == ["One_x", "Shown"]


def test_tree_listing_twice(spark, tmp_path):
    for f in ["a.png", "B.png", "sub/c.png", "sub/deep/d.png", "e/f.png", "X[ZIP]/no.png", "marked/no.png", "marked/in/no.png",
              "out/no.png", "sub/note.txt"]:
        p = tmp_path / f
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(png())
    (tmp_path / "marked" / corpus.DEFAULT_MARKER).write_text("")
    (tmp_path / corpus.DEFAULT_MARKER).write_text("")
    for _ in range(2):
        got = corpus.list_corpus(spark, str(tmp_path), exclude=str(tmp_path / "out"))
        assert rows(got, "rel_dir") == [("",), ("",), ("e",), ("sub",), ("sub/deep",)]
        assert rows(walk.walk_corpus(spark, f"file:{tmp_path}", exclude=f"file:{tmp_path}/OUT"), "path", "rel_dir", "length") == rows(got, "path", "rel_dir", "length")
    assert corpus.list_corpus(spark, str(tmp_path), recurse=False).count() == 2
    assert walk.walk_corpus(spark, str(tmp_path), recurse=False).count() == 2
    assert walk.walk_corpus(spark, str(tmp_path / "missing")).count() == 0
    assert corpus.default_output("/d/X", True) == "/d/X/X[zip]" and corpus.default_output("/d/a.png", False) == "/d/compressed"


def test_walk_does_not_descend_into_pruned_directories(spark):
    tree = {"": [("a.png", 0), ("sub", 1), ("X[ZIP]", 1), ("hidden", 1), (corpus.DEFAULT_MARKER, 0)], "/sub": [("b.png", 0), ("deep", 1)],
            "/sub/deep": [("c.png", 0), ("d.txt", 0)], "/X[ZIP]": [("no.png", 0)], "/hidden": [("no.png", 0), ("in", 1), (corpus.DEFAULT_MARKER, 0)],
            "/hidden/in": [("no.png", 0)]}
    entries = spark.createDataFrame([("/r" + d, n, bool(k), 1, None) for d, es in tree.items() for n, k in es],
                                    "dir string, name string, is_dir boolean, length long, modificationTime timestamp")
    listed, lister = [], walk.table_lister(entries)

    def watched(frontier):
        listed.extend(r.dir for r in frontier.collect())
        return lister(frontier)

    roots = spark.createDataFrame([("/r",)], "dir string")
    assert rows(walk.walk(roots, watched), "path") == [("/r/a.png",), ("/r/sub/b.png",), ("/r/sub/deep/c.png",)]
    assert sorted(listed) == ["/r", "/r/hidden", "/r/sub", "/r/sub/deep"]
    assert walk.walk(roots.limit(0), lister).count() == 0


def test_plan_files_round_trip(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"maintex": {"format": "auto", "size": 1024, "sh": 50}, "mask": {"size": 1.5, "ga": "x"}}')
    plan = rules_json.read_plan(spark, str(tmp_path / "p.json"))
    assert rows(plan, "class", "ord", "rule.format", "rule.size", "rule.sharpen_pct", "rule.gray_a") == [
        ("maintex", 0, "auto", 1024, 50, None), ("mask", 2, "keep", 0, None, None)]
    text = rules_json.plan_json(plan).first().json
    assert text == '{"maintex": {"format":"auto","size":1024,"sh":50}, "mask": {"format":"keep","size":0}}'


def test_files_of_one_row_group_are_walked_by_many_tasks(spark, small):
    from assetlake.registry import QUERIES
    for name in ("S3_assets", "S3_containers", "S3_bindings"):
        assert QUERIES[name](spark, small).rdd.getNumPartitions() >= 4


def test_verification_walks_files_once(spark, small):
    from assetlake.registry import QUERIES
    assert "MapInPandas" not in QUERIES["R16_verify"](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_preset_lists_are_gathered_after_the_exchange(spark, small):
    from assetlake.registry import QUERIES
    p = QUERIES["K2_preset_json"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert p.count("REPARTITION_BY_NUM") >= 9  # presets, owner rules and asset rules, read back three times
