"""Format and edge lengths from payload headers, as column expressions."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake.fixed import HDR_HEADER_LINES, PNG_MAGIC_HEX


def sniff(c: Column) -> Column:
    """PNG, JPEG, HDR, EXR or UNKNOWN from the leading bytes; fewer than four bytes are UNKNOWN."""
    n = F.length(c)
    lead = F.hex(F.substring(c, 1, 4))
    text = F.decode(F.substring(c, 1, 64), "ISO-8859-1")
    radiance = (n >= 10) & lead.startswith("233F") & (text.contains("RADIANCE") | text.contains("RGBE"))
    return (F.when(c.isNull() | (n < 4), F.lit("UNKNOWN"))
            .when((n > 8) & (lead == PNG_MAGIC_HEX[:8]), F.lit("PNG"))
            .when(lead.startswith("FFD8FF"), F.lit("JPEG"))
            .when(radiance, F.lit("HDR"))
            .when(lead == "762F3101", F.lit("EXR"))
            .otherwise(F.lit("UNKNOWN")))


def _int_at(c: Column, pos: int) -> Column:
    return F.conv(F.hex(F.substring(c, pos, 4)), 16, 10).try_cast("int")


def header_dims(c: Column, fmt: Column = None) -> Column:
    """S5 for PNG and HDR: struct(width, height), zeros when unreadable. JPEG needs its segment walk,
    which the inventory job does while it has the bytes at hand."""
    fmt = sniff(c) if fmt is None else fmt
    text = F.when(fmt == "HDR", F.decode(c, "ISO-8859-1"))
    head = F.regexp_extract(text, r"(?s)^((?:[^\n]+\n){1,%d})\r?\n" % HDR_HEADER_LINES, 1)
    line = F.when(head != "", F.split(text.substr(F.length(head) + 1, F.length(text)), "\n", 3))
    # what follows the header: an empty line, then the resolution line
    res = F.regexp_replace(F.get(line, F.lit(1)), "\r", "")
    pat = r"^ *[^ ]+ +(-?[0-9]+) +[^ ]+ +(-?[0-9]+) *$"
    w = F.when(fmt == "PNG", _int_at(c, 17)).when(fmt == "HDR", F.regexp_extract(res, pat, 2).try_cast("int"))
    h = F.when(fmt == "PNG", _int_at(c, 21)).when(fmt == "HDR", F.regexp_extract(res, pat, 1).try_cast("int"))
    return F.struct(F.coalesce(w, F.lit(0)).alias("width"), F.coalesce(h, F.lit(0)).alias("height"))
