"""Synthetic container bytes and small table builders."""
import struct


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + b"\0\0\0\0"


def png(idat=b"x", width=1, height=1):
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", width, height) + b"\x08\x06\0\0\0")
            + chunk(b"IDAT", idat) + chunk(b"IEND", b""))


def mp(v):
    """Encode a document value; bytes become 32-bit binaries."""
    if v is None:
        return b"\xc0"
    if isinstance(v, bool):
        return b"\xc3" if v else b"\xc2"
    if isinstance(v, int):
        return bytes([v]) if 0 <= v < 128 else (b"\xd2" + struct.pack(">i", v))
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, str):
        b = v.encode()
        return (bytes([0xa0 | len(b)]) if len(b) < 32 else bytes([0xd9, len(b)])) + b
    if isinstance(v, bytes):
        return b"\xc6" + struct.pack(">I", len(v)) + v
    if isinstance(v, list):
        return b"\xdc" + struct.pack(">H", len(v)) + b"".join(mp(x) for x in v)
    return b"\xde" + struct.pack(">H", len(v)) + b"".join(mp(k) + mp(x) for k, x in v.items())


def binding(tex, prop="MainTex", ot=1, slot=0, mat="m", coord=0):
    return {"ObjectType": ot, "CoordinateIndex": coord, "Slot": slot, "MaterialName": mat, "Property": prop, "TexID": tex}


def container(assets=None, bindings=(), shaders=(), chara=False, raw_assets=None, image=None, extra_lists=()):
    tag = ("【KoiKatuChara】" if chara else "【KoiKatuClothes】").encode()
    out = (image or png()) + b"d\0\0\0" + bytes([len(tag)]) + tag + b"\x050.0.0"
    if not chara:
        out += b"\x04name"
    out += mp({"version": "1.0", "parts": [1, 2, 3]})
    if raw_assets is not None:
        out += mp("TextureDictionary") + raw_assets
    elif assets is not None:
        out += mp("TextureDictionary") + mp(mp(assets))
    for lst in (list(bindings), *extra_lists):
        if lst:
            out += mp("MaterialTexturePropertyList") + mp(mp(lst))
    if shaders:
        out += mp("MaterialShaderList") + mp(mp(list(shaders)))
    return out


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=str)
