"""S3, S5 (JPEG), S7: the one Python job, because a binary document has to be walked byte by byte.

One file is one row, files spread over tasks, payload bytes never leave the job: assets are emitted as
(offset, length) references. Failures become rows with rc 2, 3 or 4."""
import struct
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake import fixed as K

RECORD = ("kind string, container_id string, tag string, header_version string, name string, data_version string, "
          "n_parts int, n_bytes long, rc int, reason string, asset_id string, ord int, payload_offset long, "
          "fmt string, width int, height int, list_no int, obj_type int, coord_idx int, slot int, "
          "material string, property string, shader string, shader_original string")
FIELDS = [f.split()[0] for f in RECORD.split(", ")]
PNG = bytes.fromhex(K.PNG_MAGIC_HEX)

# ship this module's functions with the job, so that executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(K)


def png_end(b) -> int:
    """Offset after the image's last chunk, by chunk lengths; -1 when the structure does not hold."""
    if b[:8] != PNG:
        return -1
    p = 8
    while p + 8 <= len(b):
        size, name = struct.unpack_from(">I4s", b, p)
        p += 12 + size
        if p > len(b):
            return -1
        if name == b"IEND":
            return p
    return -1


class Blob(tuple):
    """(offset, length) of a binary value."""


_INT = {0xcc: ">B", 0xcd: ">H", 0xce: ">I", 0xcf: ">q", 0xd0: ">b", 0xd1: ">h", 0xd2: ">i", 0xd3: ">q",
        0xca: ">f", 0xcb: ">d"}
_SIZED = {0xc4: ("bin", ">B"), 0xc5: ("bin", ">H"), 0xc6: ("bin", ">I"), 0xd9: ("str", ">B"), 0xda: ("str", ">H"),
          0xdb: ("str", ">I"), 0xdc: ("arr", ">H"), 0xdd: ("arr", ">I"), 0xde: ("map", ">H"), 0xdf: ("map", ">I")}


def read_value(b, p):
    """One document value at p -> (value, next position). Maps are lists of pairs (keys may repeat)."""
    c = b[p]
    p += 1
    if c <= 0x7f or c >= 0xe0:
        return (c if c <= 0x7f else c - 256), p
    if c in (0xc0, 0xc2, 0xc3):
        return {0xc0: None, 0xc2: False, 0xc3: True}[c], p
    if c in _INT:
        f = _INT[c]
        return struct.unpack_from(f, b, p)[0], p + struct.calcsize(f)
    if c in _SIZED:
        kind, f = _SIZED[c]
        n = struct.unpack_from(f, b, p)[0]
        p += struct.calcsize(f)
    elif c >= 0xa0:
        kind, n = "str", c & 0x1f
    elif c >= 0x90:
        kind, n = "arr", c & 0x0f
    elif c >= 0x80:
        kind, n = "map", c & 0x0f
    else:
        raise ValueError(f"unknown marker {c:#x} at {p - 1}")
    if kind in ("bin", "str") and p + n > len(b):
        raise ValueError("value runs past the end")
    if kind == "bin":
        return Blob((p, n)), p + n
    if kind == "str":
        return bytes(b[p:p + n]).decode("utf-8", "replace"), p + n
    out = []
    for _ in range(n):
        k, p = read_value(b, p)
        if kind == "map":
            v, p = read_value(b, p)
            k = (k, v)
        out.append(k)
    return out, p


def find_key(b, name: str, start: int = 0) -> int:
    """Position after the string value ``name`` (short or 8/16/32-bit length form), or -1."""
    raw = name.encode()
    heads = ([bytes([0xa0 | len(raw)])] if len(raw) < 32 else []) + [
        bytes([0xd9]) + struct.pack(">B", len(raw)), bytes([0xda]) + struct.pack(">H", len(raw)),
        bytes([0xdb]) + struct.pack(">I", len(raw))]
    hits = [(at, len(h)) for h in heads if (at := b.find(h + raw, start)) >= 0]
    at, n = min((at + n, n) for at, n in hits) if hits else (-1, 0)
    return at + len(raw) if hits else -1


def nested(b, name: str, start: int = 0):
    """(document inside the binary value of key ``name``, position after the key, reason)."""
    at = find_key(b, name, start)
    if at < 0:
        return None, -1, "missing"
    try:
        holder, _ = read_value(b, at)
        if not isinstance(holder, Blob):
            return None, at, "not a binary value"
        return read_value(b, holder[0])[0], at, ""
    except (ValueError, IndexError, struct.error):
        return None, at, "does not parse"


def jpeg_dims(b, p, end):
    """(width, height) from the first frame header between p and end, (0, 0) without one."""
    p += 2
    while p + 9 < end and b[p] == 0xff:
        m = b[p + 1]
        if 0xc0 <= m <= 0xcf and m not in (0xc4, 0xc8, 0xcc):
            h, w = struct.unpack_from(">HH", b, p + 5)
            return w, h
        p += 2 + struct.unpack_from(">H", b, p + 2)[0]
    return 0, 0


def payload_facts(b, off, n):
    """Format and edges of one payload without decoding it (same rules as sources.sniff)."""
    raw = bytes(b[off:off + min(n, 64)])
    if n > 8 and raw[:4] == PNG[:4]:
        w, h = struct.unpack_from(">ii", raw, 16) if n >= 24 else (0, 0)
        return "PNG", w, h
    if n >= 4 and raw[:3] == b"\xff\xd8\xff":
        return ("JPEG", *jpeg_dims(b, off, off + n))
    if n >= 10 and raw[:2] == b"#?" and (b"RADIANCE" in raw[:64] or b"RGBE" in raw[:64]):
        lines, at = [], off
        while at <= off + n and len(lines) <= K.HDR_HEADER_LINES + 1:
            stop = b.find(b"\n", at, off + n)
            stop = off + n if stop < 0 else stop
            lines.append(bytes(b[at:stop]).decode("latin-1"))
            at = stop + 1
        blank = next((i for i, s in enumerate(lines) if s.rstrip("\r") == ""), K.HDR_HEADER_LINES + 1)
        part = lines[blank + 1].split() if blank <= K.HDR_HEADER_LINES and blank + 1 < len(lines) else []
        try:
            return ("HDR", int(part[3]), int(part[1])) if len(part) == 4 else ("HDR", 0, 0)
        except ValueError:
            return "HDR", 0, 0
    if raw[:4] == bytes.fromhex("762F3101"):
        return "EXR", 0, 0
    return "UNKNOWN", 0, 0


def _text(b, p):
    if p >= len(b) or p + 1 + b[p] > len(b):
        return "", p + 1
    n = b[p]
    return bytes(b[p + 1:p + 1 + n]).decode("utf-8", "replace"), p + 1 + n


def _data_header(b, start):
    """(version, number of parts) of the first map around a 'version' key after ``start``."""
    at = b.find(b"\xa7version", start)
    if at < 0:
        return "", 0
    for back, ok in ((1, lambda h: 0x80 <= h <= 0x8f), (3, lambda h: h == 0xde), (5, lambda h: h == 0xdf)):
        if at - back < 0 or not ok(b[at - back]):
            continue
        try:
            m = read_value(b, at - back)[0]
        except (ValueError, IndexError, struct.error):
            continue
        m = {k: v for k, v in reversed(m) if isinstance(k, str)}
        if m.get("parts") is not None or m.get("version") is not None:
            v, parts = m.get("version"), m.get("parts")
            return (v if isinstance(v, str) else ""), (len(parts) if isinstance(parts, list) else 0)
    return "", 0


def _int(v, default):
    return v if isinstance(v, int) and not isinstance(v, bool) else default


def _lists(b, name, all_of_them):
    start, no = 0, 0
    while True:
        doc, at, _ = nested(b, name, start)
        if at < 0:
            return
        if isinstance(doc, list):
            for i, item in enumerate(doc):
                if isinstance(item, list):
                    yield no, i, {k: v for k, v in reversed([x for x in item if isinstance(x, tuple)])
                                  if isinstance(k, str)}
            no += 1
        if not all_of_them:
            return
        start = at


def container_records(cid, b):
    """All records of one file, header first."""
    head = {"kind": "container", "container_id": cid, "n_bytes": len(b), "rc": 0, "reason": ""}
    end = png_end(b)
    if end < 0:
        yield {**head, "rc": 2, "reason": "no image end"}
        return
    tag, p = _text(b, end + 4) if len(b) > end + 4 else ("", end)
    ver, p = _text(b, p) if tag else ("", p)
    chara = K.TAG_CHARA.lower() in tag.lower()
    name = "" if chara or not tag else _text(b, p)[0]
    version, parts = _data_header(b, p)
    is_card = K.TAG_WORD.lower() in tag.lower()
    head.update(tag=tag, header_version=ver, name=name, data_version=version, n_parts=parts,
                fmt="chara" if is_card and chara else ("clothes" if is_card and K.TAG_CLOTHES.lower() in tag.lower()
                                                       else None))
    doc, at, why = nested(b, K.KEY_ASSETS)
    if at < 0:
        yield {**head, "rc": 3, "reason": "no asset dictionary"}
        return
    if not isinstance(doc, list) or any(not isinstance(x, tuple) for x in doc):
        yield {**head, "rc": 4, "reason": "asset dictionary: " + (why or "not a map")}
        return
    odd = next((k for k, _ in doc if not isinstance(k, int) or isinstance(k, bool)), None)
    if odd is not None:
        yield {**head, "rc": 4, "reason": f"asset key is not an integer ({odd})"}
        return
    yield head
    for i, (k, v) in enumerate(doc):
        if isinstance(v, Blob):
            fmt, w, h = payload_facts(b, *v)
            yield {"kind": "asset", "container_id": cid, "asset_id": str(k), "ord": i, "payload_offset": v[0],
                   "n_bytes": v[1], "fmt": fmt, "width": w, "height": h}
    for no, i, m in _lists(b, K.KEY_BINDINGS, chara):
        if m.get("TexID") is None:
            continue
        yield {"kind": "binding", "container_id": cid, "list_no": no, "ord": i, "asset_id": str(m["TexID"]),
               "obj_type": _int(m.get("ObjectType"), 1), "slot": _int(m.get("Slot"), 0),
               "coord_idx": _int(m.get("CoordinateIndex"), 0),
               "material": m["MaterialName"] if isinstance(m.get("MaterialName"), str) else "",
               "property": m["Property"] if isinstance(m.get("Property"), str) else None}
    for _, i, m in _lists(b, K.KEY_SHADERS, False):
        yield {"kind": "shader", "container_id": cid, "ord": i,
               "obj_type": _int(m.get("ObjectType"), 1), "slot": _int(m.get("Slot"), 0),
               **{n: m[k] if isinstance(m.get(k), str) else "" for n, k in
                  (("material", "MaterialName"), ("shader", "ShaderName"), ("shader_original", "ShaderNameOriginal"))}}


def _scan(batches, chunk=20000):
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                rows.extend(container_records(path, content))
            except Exception as ex:  # noqa: BLE001 - a broken file is a row, not a failed job
                rows.append({"kind": "container", "container_id": path, "n_bytes": len(content), "rc": 4,
                             "reason": str(ex)})
            if len(rows) >= chunk:
                yield _frame(rows)
                rows = []
        if rows:
            yield _frame(rows)


def _frame(rows):
    return pd.DataFrame({f: pd.Series([r.get(f) for r in rows], dtype=object) for f in FIELDS})


def inventory_records(files: DataFrame) -> DataFrame:
    """S3: one tagged record stream. Write it to a table once (session.cut_lineage) and split that.

    Arrow batches hold whole files: for large containers keep
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` at a few rows."""
    return files.select("path", "content").mapInPandas(_scan, RECORD)


def inventory(records: DataFrame) -> dict:
    """S3: containers, assets, bindings and shaders out of the record stream."""
    k = F.col("kind")
    cont = records.where(k == "container").select(
        "container_id", F.coalesce("fmt", F.lit("other")).alias("kind"), "tag", "header_version", "name",
        "data_version", F.coalesce("n_parts", F.lit(0)).alias("n_parts"), "n_bytes", "rc", "reason")
    assets = records.where(k == "asset").select(
        "container_id", F.col("asset_id").cast("long").alias("asset_id"), "ord", "payload_offset", "n_bytes", "fmt",
        "width", "height", F.greatest("width", "height").alias("dim"))
    bindings = records.where(k == "binding").select(
        "container_id", "list_no", "ord", "obj_type", "coord_idx", "slot", "material", "property",
        F.col("asset_id").try_cast("long").alias("asset_id"))
    shaders = records.where(k == "shader").select(
        "container_id", "ord", "obj_type", "slot", "material", "shader", "shader_original")
    return {"containers": cont, "assets": assets, "bindings": bindings, "shaders": shaders}


def _payloads(marker):
    mark = marker.encode("ascii")

    def run(batches):
        for pdf in batches:
            out = [trailer_text(c, mark) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "json": pd.Series(out, dtype=object)})
    return run


def trailer_text(b, mark):
    """JSON text of a preset file: after the image end, marker + int32 length + text; a file that is no
    image and has no trailer is its own text; None when there is neither."""
    end = png_end(b)
    at = b.find(mark, max(end, 0))
    while at >= 0 and at + len(mark) + 4 <= len(b):
        n = struct.unpack_from("<i", b, at + len(mark))[0]
        off = at + len(mark) + 4
        if n > 0 and off + n <= len(b):
            return bytes(b[off:off + n]).decode("utf-8", "replace")
        at = b.find(mark, at + 1)
    if b[:8] == PNG:
        return None
    return bytes(b).decode("utf-8", "replace").lstrip("﻿")


def preset_texts(files: DataFrame, marker: str = "AssetPreset1") -> DataFrame:
    """Path, json (NULL: not a preset). Pass the trailer marker of the tool that wrote the files."""
    return files.select("path", "content").mapInPandas(_payloads(marker), "path string, json string")
