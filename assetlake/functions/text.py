"""Text columns."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake import fixed as K
from assetlake.functions import glossary, keys
from assetlake.operators.skew import salted_join


def norm_material(c: Column) -> Column:
    """Drop one trailing copy suffix; what stands before it must not be empty."""
    return F.coalesce(F.regexp_replace(c, r"(?is)^(.+)\.MECopy[0-9]*\z", "$1"), F.lit(""))


def signature(key: Column, material: Column, prop: Column) -> Column:
    """token|material|property."""
    return F.concat_ws("|", keys.owner_token(key), norm_material(material), F.coalesce(prop, F.lit("")))


def signatures_chara(obj_type: Column, coord: Column, slot: Column, material: Column, prop: Column) -> Column:
    """P7 for grouped containers: array of the grouped signature and, for body types, the group-less one."""
    key = keys.owner_key(obj_type, slot)
    grouped = F.concat_ws("|", keys.group_slot_name(keys.group_of(obj_type, coord), key),
                          norm_material(material), F.coalesce(prop, F.lit("")))
    return F.when(obj_type >= 3, F.array(grouped, signature(key, material, prop))).otherwise(F.array(grouped))


def human_bytes(n: Column) -> Column:
    """P8."""
    def scaled(power, unit):
        return F.format_string("%.2f " + unit, F.round(n.cast("double") / float(1024 ** power), 2))
    return (F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
            .when(n < 1024 ** 2, scaled(1, "KB"))
            .when(n < 1024 ** 3, scaled(2, "MB"))
            .otherwise(scaled(3, "GB")))


_UNITS = {"B": 1, "KB": 1024, "MB": 1024 ** 2, "GB": 1024 ** 3}


def parse_display_number(c: Column, kind: str) -> Column:
    """The number behind a displayed cell. kind: count, id, dim, own or size; dash and junk give 0."""
    text = F.trim(c)
    if kind in ("count", "id"):
        n = text.try_cast("long")
    elif kind == "dim":
        n = F.bround(F.regexp_extract(text, r"(?i)^\s*([0-9.]+)", 1).try_cast("double"), 0).cast("long")
    else:
        if kind == "own":
            text = F.when(text.contains("/"), F.trim(F.element_at(F.split(text, "/"), -1)))
        number = F.regexp_extract(text, r"^([0-9.]+)", 1).try_cast("double")
        unit = F.upper(F.regexp_extract(text, r" ([A-Za-z]+)$", 1))
        factor = F.lit(1.0)
        for u, f in _UNITS.items():
            factor = F.when(unit == u, F.lit(float(f))).otherwise(factor)
        n = (number * factor).cast("long")
    return F.coalesce(n, F.lit(0).cast("long"))


def props_text(arr: Column) -> Column:
    """P10: distinct, ordinal order, comma-joined; '-' when empty."""
    joined = F.array_join(F.array_sort(F.array_distinct(arr)), ",")
    return F.when(F.size(arr) > 0, joined).otherwise(F.lit("-"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)\z", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*\z", "")


def sanitize_name(c: Column) -> Column:
    """Trim, then characters that file systems refuse become '_'."""
    return F.regexp_replace(keys.trim_space(F.coalesce(c, F.lit(""))), r'[\x00-\x1f"<>|:*?\\/]', "_")


def preset_file_name(custom: Column, container: Column, ext: str = "png") -> Column:
    """[preset]name_stem.ext with fallbacks 'preset' and 'card'."""
    name, stem = sanitize_name(custom), file_stem(container)
    return F.concat(F.lit("[preset]"), F.when(name == "", F.lit("preset")).otherwise(name), F.lit("_"),
                    F.when(file_name(container) == "", F.lit("card")).otherwise(stem), F.lit("." + ext))


def norm_format(c: Column) -> Column:
    """Format words; empty is auto, unknown words stay."""
    t = F.lower(keys.trim_space(F.coalesce(c, F.lit(""))))
    out = F.when(t == "", F.lit("auto"))
    for word, fmt in K.FORMAT_WORDS.items():
        out = out.when(t == word, F.lit(fmt))
    return out.otherwise(t)


def norm_size(c: Column, default: int = 1024) -> Column:
    """Size words; 'no scaling' words are 0, junk and empty take the default."""
    t = keys.trim_space(F.coalesce(c, F.lit("")))
    return (F.when(t.isin(*K.NO_SCALING_WORDS), F.lit(0))
            .otherwise(F.coalesce(t.try_cast("int"), F.lit(default))))


def parse_rule_spec(df: DataFrame, c: str, default_size: int = 1024) -> DataFrame:
    """Explode ``owner:format:size,...`` to one row per owner, last entry of a text wins; an empty text or the word
    all gives the default rule to every clothes slot; NULL gives no rows.

    Everything happens inside the row, so nothing is shuffled and equal rows stay apart."""
    entry = F.transform(F.split(F.col(c), ","), lambda x: F.split(keys.trim_space(x), ":"))
    one = F.transform(entry, lambda f: F.struct(
        keys.owner_from_token(F.element_at(f, 1)).alias("owner_key"), norm_format(F.get(f, F.lit(1))).alias("format"),
        norm_size(F.get(f, F.lit(2)), default_size).alias("size"), (F.array_join(f, ":") != "").alias("named")))
    one = F.filter(one, lambda e: e["named"] & (e["owner_key"] >= 0))
    every = F.array(*[F.struct(F.lit(i).alias("owner_key"), F.lit("auto").alias("format"), F.lit(1024).alias("size"),
                               F.lit(True).alias("named")) for i in range(len(K.SLOT_TOKENS))])
    entries = F.when(F.lower(keys.trim_space(F.col(c))).isin("", "all"), every).otherwise(one)
    rows = df.select(*df.columns, entries.alias("_e"))
    last = F.filter("_e", lambda e, i: ~F.exists(F.slice(F.col("_e"), i + 2, F.size("_e")), lambda f: f["owner_key"] == e["owner_key"]))
    rows = rows.select(*df.columns, F.explode(last).alias("_r"))
    return rows.select(*df.columns, "_r.owner_key", "_r.format", "_r.size")


def rc_text(c: Column) -> Column:
    """P19."""
    out = None
    for code, text in K.RC_TEXT.items():
        out = F.when(c == code, F.lit(text)) if out is None else out.when(c == code, F.lit(text))
    return out.otherwise(F.concat(F.lit(K.RC_UNKNOWN_PREFIX), c.cast("string")))


def _regex_quote(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in s)


def translate_terms(c: Column, terms: dict, patterns=()) -> Column:
    """P20: whole-string hit, else left-to-right longest match, pattern rules first, else unchanged.

    ``terms`` is a glossary (source -> target) that becomes part of the plan; ``translate_glossary`` takes one of any size
    as a table. ``patterns`` are (regex with one group, replacement prefix) pairs tried before the glossary at every
    position."""
    words = sorted((k for k in terms if k), key=len, reverse=True)
    rules = [p for p, _ in patterns]
    keys_re = "|".join(rules + [_regex_quote(w) for w in words])
    # a stretch where no key starts is one token, so the token array grows with hits, not with characters
    token = "(?s)(?:" + keys_re + "|(?:(?!" + keys_re + ").)+)" if keys_re else "(?s).+"
    lookup = F.create_map(*[F.lit(x) for kv in sorted(terms.items()) for x in kv]) if terms else None

    def one(piece):
        hit = F.coalesce(F.try_element_at(lookup, piece), piece) if terms else piece
        for regex, prefix in reversed(list(patterns)):
            hit = F.when(piece.rlike("(?s)^" + regex + r"\z"),
                         F.concat(F.lit(prefix), F.regexp_extract(piece, regex, 1))).otherwise(hit)
        return hit
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(token), 0), one), "")


DEEPEST = 8  # characters of a term at most that a place in a text must show before the whole term is looked up
SHALLOW = 4  # the same where the whole term is at hand
FEW = 50_000  # terms, or heads of terms, that every task may hold
FEW_CHARS = 4_000_000  # of a glossary that every task may hold


def translate_glossary(df: DataFrame, c: str, terms: DataFrame, name: str = "translated") -> DataFrame:
    """P20 for a glossary table (source, target) of any size: every row of ``df`` with the translation of column ``c``.

    The glossary is measured first. A small one (``FEW`` terms of ``FEW_CHARS`` characters) goes to the tasks as it is, and no
    row moves. Of a larger one the tasks get a trie cut after its first levels, as deep as ``FEW`` heads allow (``DEEPEST`` at
    most): terms that are no longer than a head are known by it, for longer ones a text asks once for each different string
    that begins and is as long as some term. What is asked meets the terms in a join whose frequent strings are dealt over
    salts, and goes back to its text. Of the longest terms at their places the leftmost are taken in turn. Each different
    text of a large glossary is translated once; a null text stays null. Of a source named twice the greatest target counts."""
    terms = terms.where(F.col("source").isNotNull() & (F.col("source") != "")).groupBy("source").agg(
        F.coalesce(F.max("target"), F.lit("")).alias("target"))
    head = lambda n: F.substring("source", 1, n)
    n_chars = F.length("source")
    n, total, *wide = terms.agg(F.count(F.lit(1)), F.sum(n_chars + F.length("target")), *[
        F.approx_count_distinct(head(k)) for k in range(1, DEEPEST + 1)]).first()
    depth = max([k for k, w in enumerate(wide, 1) if w <= FEW], default=1)
    small = n <= FEW and (total or 0) <= FEW_CHARS
    if small:
        depth = min(depth, SHALLOW)
    short = F.lit(True) if small else n_chars <= depth
    few = terms.groupBy(head(depth).alias("head")).agg(
        F.collect_set(n_chars).alias("lengths"), F.collect_list(F.when(short, F.struct("source", "target"))).alias("known")).collect()
    heads = glossary.Heads({r["head"]: r["lengths"] for r in few})
    known = {k["source"]: k["target"] for r in few for k in r["known"]}
    if len(known) == n:
        put = F.udf(lambda t: None if t is None else glossary.replaced(t, heads, known), "string", useArrow=False)
        return df.withColumn(name, put(F.col(c)))

    ask = F.udf(lambda t: glossary.asked(t, heads, depth), "array<string>", useArrow=False)
    put = F.udf(lambda t, s, to: glossary.replaced(t, heads, known, dict(zip(s or (), to or ()))), "string", useArrow=False)
    key = F.when(F.length(c) < 64, F.col(c)).otherwise(F.sha2(F.col(c), 256))  # the hash has 64 characters
    texts = df.where(F.col(c) != "").select(key.alias("_d"), F.col(c).alias("_t")).dropDuplicates(["_d"])
    wanted = texts.select("_d", F.explode(ask("_t")).alias("source"))
    met = salted_join(wanted, terms.where(~short), ["source"], ["_d"])
    hits = met.groupBy("_d").agg(F.collect_list(F.struct("source", "target")).alias("_h"))
    done = texts.join(hits, "_d", "left").select("_d", put("_t", "_h.source", "_h.target").alias("_new"))
    j = df.withColumn("_key", key).join(done, F.col("_key") == F.col("_d"), "left")
    return j.withColumn(name, F.coalesce("_new", F.col(c))).drop("_key", "_d", "_new")


# ---- fixed values: script range, and the two shapes of "script then ASCII name" ({s} is the script range) ----
CJK = "\\u4e00-\\u9fff"
TAIL_PATTERN = "(?U)^[\\u3000-\\u303f{s}()（）\\s]*\\s([A-Za-z][A-Za-z0-9_\\-]*(?:\\s[A-Za-z0-9_\\-]+)*)$"
FRAGMENT_PATTERN = "(?U)[{s}][{s}\\u3000()（）/\\u00b7\\s]*?\\s([A-Za-z][A-Za-z0-9_\\-]{1,})"


def has_cjk(c: Column, char_class: str = CJK) -> Column:
    """Any character of the class (default: CJK unified ideographs)."""
    return F.coalesce(c.rlike("[" + char_class + "]"), F.lit(False))


def strip_tail(c: Column, char_class: str = CJK) -> Column:
    """A text that is script followed by one ASCII name keeps only the name; inside a sentence
    each 'script name' fragment is reduced to its name."""
    tail, frag = TAIL_PATTERN.replace("{s}", char_class), FRAGMENT_PATTERN.replace("{s}", char_class)
    return (F.when(c.rlike(tail), F.regexp_replace(c, tail, "$1"))
            .when(has_cjk(c, char_class), F.regexp_replace(c, frag, "$1"))
            .otherwise(c))
