"""Container and preset files that Spark builds from the part table, byte for byte, so that the readers
have real documents to read and the part table itself is the oracle."""
from pyspark.sql import functions as F

from assetlake import fixed as K
from assetlake.registry.views import property_of_part


def _hex(c):
    return F.hex(F.encode(c, "utf-8"))


def _be(n, width=8):
    return F.lpad(F.hex(n.cast("long")), width, "0")


def mp_str(c):
    """Document string of at most 31 bytes."""
    h = _hex(c)
    return F.concat(F.lpad(F.hex((F.length(h) / 2).cast("long") + 160), 2, "0"), h)


def mp_bin(h):
    return F.concat(F.lit("C6"), _be(F.length(h) / 2), h)


def mp_int(n):
    return F.concat(F.lit("CE"), _be(n))


def mp_map(*pairs):
    out = [F.lit(f"{0x80 + len(pairs):02X}")]
    for k, v in pairs:
        out += [mp_str(F.lit(k)), v]
    return F.concat(*out)


def key_value(key, value):
    raw = key.encode()
    head = f"{0xa0 + len(raw):02X}" if len(raw) < 32 else f"D9{len(raw):02X}"
    return F.concat(F.lit(head + raw.hex().upper()), value)


# an image whose data contains the bytes of an end chunk's name
_PNG = ("89504E470D0A1A0A" + "0000000D49484452" + "00000001" * 2 + "0806000000" + "00000000"
        + "0000000C49444154" + "49454E44AE426082AABBCCDD" + "00000000" + "0000000049454E44AE426082")


def _len1(text):
    h = _hex(text)
    return F.concat(F.lpad(F.hex((F.length(h) / 2).cast("long")), 2, "0"), h)


def _payload(i, part_key, size, name):
    """Payload of asset i of a part: PNG, JPEG, HDR or unknown bytes, followed by the part name."""
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _be(size * 128), _be(size * 64 + i), F.lit("0806000000"))
    jpg = F.concat(F.lit("FFD8FFE00004ABCDFFC0000B08"), _be(size * 16, 4), _be(size * 32, 4))
    hdr = _hex(F.format_string("#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y %d +X %d\n", size + i, size * 2))
    lead = F.when(i == 0, png).when(i == 1, jpg).when(i == 2, hdr).otherwise(F.lit("01020304"))
    return F.concat(lead, _hex(name))


def container_files(v):
    """path, content: one container per part. Types: SMALL is no image, LARGE has no dictionary, MEDIUM
    a dictionary that is not binary, PROMO is grouped (with a second binding list), the rest plain."""
    k, size, name, t = F.col("p_partkey"), F.col("p_size"), F.col("p_name"), F.col("p_type")
    chara = t == "PROMO"
    tag = F.when(chara, F.lit("【KoiKatuChara】")).otherwise(F.lit("【KoiKatuClothes】"))
    head = F.concat(F.lit(_PNG + "64000000"), _len1(tag), _len1(F.lit("0.0.1")),
                    F.when(chara, F.lit("")).otherwise(_len1(name)))
    data = F.concat(F.lit("82"), key_value("version", mp_str(F.lit("1.2.3"))),
                    key_value("parts", F.concat(F.lpad(F.hex(size % 5 + 144), 2, "0"), F.repeat(F.lit("C0"), size % 5))))
    n = size % 4 + 1
    ids = F.sequence(F.lit(0), n - 1)
    entries = F.array_join(F.transform(ids, lambda i: F.concat(mp_int(k * 10 + i), mp_bin(_payload(i, k, size, name)))), "")
    assets = key_value(K.KEY_ASSETS, F.when(t == "MEDIUM", F.lit("C0")).otherwise(
        mp_bin(F.concat(F.lpad(F.hex(n + 128), 2, "0"), entries))))

    def binding(i, prop):
        return mp_map(("ObjectType", mp_int(i + 1)), ("CoordinateIndex", mp_int(i * 2)), ("Slot", mp_int(size % 9)),
                      ("MaterialName", mp_str(name)), ("Property", mp_str(prop)), ("TexID", mp_int(k * 10 + i)))
    first = F.transform(F.filter(ids, lambda i: i < n - 1), lambda i: binding(i, property_of_part()))
    one = mp_bin(F.concat(F.lpad(F.hex(F.size(first) + 144), 2, "0"), F.array_join(first, "")))
    second = key_value(K.KEY_BINDINGS, mp_bin(F.concat(F.lit("91"), binding(F.lit(3), F.lit("LateTex")))))
    lists = F.concat(key_value(K.KEY_BINDINGS, one), F.when(chara, second).otherwise(F.lit("")))
    shader = mp_map(("ObjectType", mp_int(F.lit(1))), ("Slot", mp_int(size % 9)), ("MaterialName", mp_str(name)),
                    ("ShaderName", mp_str(F.concat(F.lit("main_"), F.lower(t)))), ("ShaderNameOriginal", mp_str(F.lit("old"))))
    shaders = key_value(K.KEY_SHADERS, mp_bin(F.concat(F.lit("91"), shader)))
    whole = (F.when(t == "SMALL", _hex(F.concat(F.lit("not an image "), name)))
             .when(t == "LARGE", F.concat(head, data)).otherwise(F.concat(head, data, assets, lists, shaders)))
    path = F.concat(F.lit("corpus/"), F.regexp_replace("p_brand", "#", ""), F.lit("/part-"), k, F.lit(".png"))
    return v.spread_part.select(path.alias("path"), F.unhex(whole).alias("content"))


PATH_SQL = "'corpus/' || replace(p_brand, '#', '') || '/part-' || p_partkey || '.png'"

PRESET_MARKER = "AssetPreset1"


def preset_files(v):
    """path, content: one preset file per part; an image with a trailer, plain JSON, a trailer whose
    length does not fit (no preset), or an image without trailer (no preset)."""
    k, size, t = F.col("p_partkey"), F.col("p_size"), F.col("p_type")
    owner = F.when(t == "PROMO", F.lit(100003)).otherwise(size % 9)
    size_json = F.when(size > 40, F.lit('"big"')).otherwise((size * 16).cast("string"))
    json = F.concat(
        F.lit('{"name": "'), F.when(size > 25, F.col("p_name")).otherwise(F.lit("")), F.lit('", "source": "'), F.col("p_brand"),
        F.lit('", "minMatch": 0.'), size % 10, F.lit(', "zzz": [1, {"q": null}], "sigs": ["s1|'), F.col("p_name"),
        F.lit('", "s2"], "parts": {"'), owner.cast("string"),
        F.lit('": {"format": "png", "size": '), size_json, F.lit(', "sh": 50, "up": -1}, "junk": {"format": "jpeg"}}, "textures": [{"id": "'),
        k.cast("string"), F.lit('", "format": 7, "size": 64, "ga": 1, "sigs": ["a|'), F.col("p_name"), F.lit('"]}]}'))
    body = _hex(json)
    length = F.length(body) / 2
    le = F.concat(*[F.lpad(F.hex(F.shiftright(length.cast("int"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)])
    mark = F.lit(PRESET_MARKER.encode().hex().upper())
    full = (F.when(t == "LARGE", body).when(t == "SMALL", F.concat(F.lit(_PNG), mark, F.lit("FFFFFF7F"), body))
            .when(t == "MEDIUM", F.lit(_PNG)).otherwise(F.concat(F.lit(_PNG), mark, le, body)))
    ext = F.when(t == "LARGE", F.lit(".json")).otherwise(F.lit(".png"))
    path = F.concat(F.lit("presets/[preset]"), F.col("p_type"), F.lit("_"), k, ext)
    return v.spread_part.select(path.alias("path"), F.unhex(full).alias("content"))


PRESET_PATH_SQL = "'presets/[preset]' || p_type || '_' || p_partkey || CASE p_type WHEN 'LARGE' THEN '.json' ELSE '.png' END"
