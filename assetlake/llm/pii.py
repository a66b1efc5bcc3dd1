r"""PII surrogates, DataFrame functions only.

Mail addresses, IPv4 and IPv6 addresses, MAC addresses, IBANs and long numbers (cards, phones) are found by patterns in any
script; person names by a title or cue word before capitalised words, or by a table of given names. A name word found once in
a document is a name wherever the document has it capitalised. What is one entity after normalisation (case, separators of
numbers) gets one surrogate everywhere: a given name another one of its gender and script, all else a keyed draw of the same
format, each letter and digit from its own alphabet and case; octets stay below 256, the last label of a mail domain and the
country of an IBAN are kept. No surrogate meets another or an entity of the corpus while its format has values left.
"""
import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlake.llm.common import materialise, row_key

# Given names by gender and script, titles and cue words, the patterns.
GIVEN = {
    "f latin": """anna maria julia laura sarah sophie claire camille isabelle nathalie katharina johanna susanne ingrid heike monika sabine
        lucía carmen isabel pilar marta elena teresa cristina mary patricia jennifer linda elizabeth barbara susan jessica emily olivia
        emma charlotte hannah lena zoé élodie françoise hélène mónica sofía inés""",
    "m latin": """john james robert michael william david richard joseph thomas daniel matthew andrew peter stephen george edward hans klaus
        jürgen stefan wolfgang andreas matthias günter heinrich pierre jean jacques françois antoine julien nicolas olivier jérôme
        josé juan carlos miguel javier alejandro antonio manuel francisco fernando pablo sergio""",
    "f cyrillic": "анна мария елена ольга наталья татьяна ирина светлана екатерина людмила юлия галина дарья софья ксения",
    "m cyrillic": "иван сергей дмитрий александр андрей алексей михаил николай владимир павел юрий виктор борис константин олег",
    "f greek": "μαρία ελένη κατερίνα βασιλική σοφία άννα ιωάννα δήμητρα αγγελική ευαγγελία",
    "m greek": "γιώργος γιάννης δημήτρης νίκος κώστας παναγιώτης βασίλης χρήστος ανδρέας σπύρος",
}
TITLES = """mr mrs ms miss sir madam dr prof professor herr herrn frau fräulein monsieur madame mademoiselle mme mlle señor señora señorita sr sra
    srta don doña signor signora господин госпожа г-н г-жа доктор кύριος κύριος κυρία κ"""
CUES = ["my name is", "named", "ich heiße", "mein name ist", "je m'appelle", "je m’appelle", "mon nom est", "me llamo", "mi nombre es", "mi chiamo",
        "меня зовут", "με λένε"]
_NO, _END = r"(?<![\p{L}\p{M}\p{N}_])", r"(?![\p{L}\p{M}\p{N}_])"
_CAP = r"\p{Lu}[\p{L}\p{M}'’]*+"
_MORE = r"(?:(?: (?:von|van|der|den|de|del|della|da|di|du|la|le|zu|bin|ibn|al|фон))*+(?: |-)" + _CAP + r"){0,3}"
_BEFORE = "|".join([*(rf"{t}\.?" for t in dict.fromkeys(TITLES.split())), *CUES])
_NAMES = "|".join(sorted((n for names in GIVEN.values() for n in names.split()), key=lambda n: (-len(n), n)))
_FIRST = "".join(sorted({x for t in [*TITLES.split(), *CUES] for x in (t[0], t[0].upper())}))
LEAD = rf"(?:(?=[{_FIRST}])(?iu:{_BEFORE}) )+"
NAME = rf"{LEAD}{_CAP}{_MORE}|(?=\p{{Lu}})(?iu:{_NAMES}){_END}{_MORE}"
CUED = r"(?<=السيد |السيدة |מר |גברת )[\p{IsArabic}\p{IsHebrew}]++|\p{IsHan}{1,3}(?=先生|女士|小姐)"
MAIL = r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]+(?:\.[\p{L}\p{M}\p{N}-]+)*\.[\p{L}\p{M}]{2,}"
IBAN = rf"{_NO}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}"
HEX = rf"{_NO}(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|(?:[0-9A-Fa-f]{{2}}[:-]){{5}}[0-9A-Fa-f]{{2}}){_END}"
IP = rf"{_NO}[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}{_END}"
NUMBER = rf"(?:{_NO}\+)?{_NO}\p{{Nd}}(?:[ ()-]?\p{{Nd}}){{8,18}}{_END}"
FORM = rf"{MAIL}|{IBAN}|{HEX}|{IP}|{NUMBER}"
#: An entity by its format, a name with what leads to it, or a capitalised word: a name if the document has it in one.
PATTERN = rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{FORM}|{_NO}(?:{NAME}|{_CAP}))|{CUED}"
#: What a text with any entity has in it. Most texts have nothing of it, and these need not be searched for PATTERN.
HINTS = [r"(?=[\p{Nd}:@-])(?:@|(?<=[0-9A-Fa-f])[:-][0-9A-Fa-f]|[0-9]\.[0-9]|(?<=[A-Z]{2})[0-9]{2}|\p{Nd}(?:[ ()-]?\p{Nd}){8})",
         rf"{_NO}(?:(?=[{_FIRST}])(?iu:{_BEFORE}) \p{{Lu}}|(?=\p{{Lu}})(?iu:{_NAMES}))",
         r"[\u0590-\u08FF\u2E80-\x{10FFFF}]"]  # holds the scripts of CUED
TOKEN = r"\p{Lu}[\p{L}\p{M}'’]*|(?<![\p{L}\p{M}'’])[\p{IsArabic}\p{IsHebrew}\p{IsHan}]+"


def _alphabets():
    """(first, last, step) of the runs of letters or digits of one script and case; small and capital letters alternate in some."""
    kind = lambda c: (unicodedata.category(chr(c)), unicodedata.name(chr(c), "").split(" ")[0])
    runs = []
    for step in (1, 2):
        done = {c for lo, hi, s in runs for c in range(lo, hi + 1, s)}
        for c in range(0x30, 0xFFF0):
            k = kind(c)
            if c in done or k[0] not in ("Lu", "Ll", "Lo", "Nd"):
                continue
            lo = hi = c
            while hi + step < 0xFFF0 and hi + step not in done and kind(hi + step) == k:
                hi += step
            done.update(range(lo, hi + 1, step))
            if hi > lo:
                runs.append((lo, hi, step))
    return runs


def _slots(norm, kind):
    """For each character of a normalised entity: the first of its alphabet, how many there are, the step; one when it is kept."""
    runs = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit((hi - lo) // s + 1).alias("n"), F.lit(s).alias("step")) for lo, hi, s in _alphabets()])
    tail = F.when(kind == "mail", F.length(F.regexp_extract(norm, r"\.[\p{L}\p{M}]+\z", 0))).otherwise(F.lit(0))

    def one(c, i):
        cp = F.ascii(c)
        fixed = lambda lo, n: F.struct(F.lit(lo).alias("lo"), F.lit(n).alias("n"), F.lit(1).alias("step"))
        own = F.struct(cp.alias("lo"), F.lit(1).alias("n"), F.lit(1).alias("step"))
        rest = F.filter(runs, lambda r: (cp >= r["lo"]) & (cp <= r["lo"] + (r["n"] - 1) * r["step"]) & (F.pmod(cp - r["lo"], r["step"]) == 0))
        keep = (i >= F.length(norm) - tail) | (kind == "iban") & (i < 2)
        return F.when(keep, own).when(cp.between(48, 57), fixed(48, 10)).when((kind == "hex") & cp.between(97, 102), fixed(97, 6)).when(
            cp.between(97, 122), fixed(97, 26)).when(cp < 128, own).otherwise(F.coalesce(F.get(rest, F.lit(0)), own))
    return F.transform(F.split(norm, ""), one)


def _char(slot, k):
    return F.decode(F.unhex(F.lpad(F.hex(slot["lo"] + k * slot["step"]), 4, "0")), "UTF-16BE")


def _drawn(key):
    """A surrogate of the format, by the key, the entity and the number of the draw."""
    draw = lambda i, n: F.pmod(F.xxhash64(F.lit(key), "salt", "kind", "norm", i), n).cast("int")
    free = lambda s, i: F.when(s["n"] > 1, _char(s, draw(i, s["n"]))).otherwise(F.substring("norm", i + 1, F.lit(1)))
    octets = F.array_join(F.transform(F.split("norm", r"\."), lambda c, i: draw(i, F.lit(256)).cast("string")), ".")
    return F.when(F.col("kind") == "ip", octets).otherwise(F.array_join(F.transform("slots", free), ""))


def _numbered(slots, kept, number):
    """The value of that number among all values of a format."""
    def step(acc, s, i):
        c = F.when(s["n"] > 1, _char(s, F.pmod(acc["rest"], s["n"]).cast("int"))).otherwise(F.substring(kept, i + 1, F.lit(1)))
        return F.struct(F.floor(acc["rest"] / s["n"]).cast("long").alias("rest"), F.concat(c, acc["out"]).alias("out"))
    at = F.transform(slots, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    return F.aggregate(F.reverse(at), F.struct(number.cast("long").alias("rest"), F.lit("").alias("out")), lambda acc, x: step(acc, x["s"], x["i"]))["out"]


def _given(units, key):
    """Given names: the free ones of the table of their gender and script, then pairs of its names."""
    table = units.sparkSession.createDataFrame([(g, n) for g, names in GIVEN.items() for n in dict.fromkeys(names.split())], "grp string, norm string")
    by = Window.partitionBy("grp").orderBy(F.xxhash64(F.lit(key), "norm"), "norm")
    real = table.join(units.where("kind = 'name'").select("norm"), "norm", "left_semi").withColumn("r", F.row_number().over(by) - 1)
    free = table.join(real, "norm", "left_anti").withColumn("r", F.row_number().over(by) - 1)
    free = free.select("grp", "r", F.col("norm").alias("new"))
    first = free.groupBy("grp").agg(F.count("*").alias("n_free"))
    every = table.withColumn("i", F.row_number().over(by) - 1).groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "norm"))), lambda x: x["norm"]).alias("all"))
    j = real.join(free, ["grp", "r"], "left").join(first, "grp", "left").join(every, "grp")
    over = F.col("r") - F.coalesce("n_free", F.lit(0))
    pair = F.concat(F.get("all", F.pmod(over, F.size("all"))), F.lit("-"), F.get("all", F.pmod(over + 1, F.size("all"))))
    return j.select(F.lit("name").alias("kind"), "norm", F.coalesce("new", pair).alias("new"), F.lit(True).alias("given"))


def _surrogates(units, key):
    """new for each (kind, norm); small formats, with at most four values for an entity, by rank among the values left; the
    others are drawn until none clashes: at least half of their values stay free, so each draw settles half of the rest."""
    given = materialise(_given(units, key))
    u = units.join(F.broadcast(given.select("kind", "norm")), ["kind", "norm"], "left_anti").withColumn("slots", _slots(F.col("norm"), F.col("kind")))
    mask = F.array_join(F.transform("slots", lambda s, i: F.when(s["n"] > 1, F.concat(F.lit("\x01"), s["lo"], F.lit("/"), s["step"])).otherwise(
        F.substring("norm", i + 1, F.lit(1)))), "\x00")
    room = F.when(F.col("kind").isin("ip"), F.lit(2.0 ** 32)).otherwise(F.aggregate("slots", F.lit(1.0), lambda a, s: a * s["n"]))
    u = materialise(u.withColumn("mask", F.xxhash64("kind", mask)).withColumn("room", room))
    many = u.groupBy("kind", "mask").agg(F.count("*").alias("n"), F.first("room").alias("room"), F.min("norm").alias("kept"), F.min_by("slots", "norm").alias("slots"))
    small = materialise(many.where(F.col("room") <= 4 * F.col("n")))
    chunk = 1 << 16
    values = small.select("kind", "mask", "kept", "slots", "room", F.explode(F.sequence(F.lit(0), F.floor((F.col("room") - 1) / chunk).cast("int"))).alias("hi"))
    values = values.withColumn("number", F.explode(F.sequence(F.col("hi").cast("long") * chunk, F.least(F.col("room").cast("long"), (F.col("hi").cast("long") + 1) * chunk) - 1)))
    values = values.select("kind", "mask", _numbered(F.col("slots"), F.col("kept"), F.col("number")).alias("new"))
    real = u.select("kind", F.col("norm").alias("new"), F.lit(1).alias("real"))
    values = values.join(real, ["kind", "new"], "left").withColumn("real", F.coalesce("real", F.lit(0)))
    # the values that are no entity first; entities only when those are used up, shifted by one so that none is its own
    order = lambda c: F.xxhash64(F.lit(key), c)
    fresh = values.groupBy("kind", "mask").agg(F.sum(1 - F.col("real")).alias("n_fresh"))
    values = values.withColumn("at", F.row_number().over(Window.partitionBy("kind", "mask", "real").orderBy(order("new"), "new")) - 1)
    mine = u.join(small.select("kind", "mask", "n"), ["kind", "mask"]).join(fresh, ["kind", "mask"])
    mine = mine.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "mask").orderBy(order("norm"), "norm")) - 1)
    other = F.col("rank") >= F.col("n_fresh")
    mine = mine.withColumn("real", other.cast("int")).withColumn("at", F.when(other, F.pmod(F.col("rank") + 1, F.col("n"))).otherwise(F.col("rank")))
    exact = materialise(mine.join(values, ["kind", "mask", "real", "at"], "left").select("kind", "norm", F.coalesce("new", "norm").alias("new")))
    names = u.join(small.select("kind", "mask"), ["kind", "mask"], "left_anti").select("kind", "norm", "slots", F.lit(0).alias("salt"))
    names = materialise(names.withColumn("new", _drawn(key)))
    fixed = units.select("kind", F.col("norm").alias("new")).unionByName(exact.select("kind", "new")).unionByName(given.select("kind", "new")).select(
        "kind", "new", F.lit(None).cast("string").alias("first"))
    while True:
        first = names.groupBy("kind", "new").agg(F.min("norm").alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "new", "first")
        clash = first.unionByName(fixed).groupBy("kind", "new").agg(F.max("first").alias("first"), F.max(F.col("first").isNull()).alias("taken"))
        bad = names.join(clash, ["kind", "new"]).where(F.col("taken") | (F.col("norm") != F.col("first"))).select("kind", "norm", F.lit(True).alias("again"))
        if not bad.take(1):
            break
        names = names.drop("new").join(bad, ["kind", "norm"], "left").withColumn("salt", F.when(F.col("again"), F.col("salt") + 1).otherwise(F.col("salt"))).drop("again")
        names = materialise(names.withColumn("new", _drawn(key)))
    rest = names.select("kind", "norm", "new").unionByName(exact).withColumn("given", F.lit(False))
    return rest.unionByName(given)


def _lower(c):
    return F.when(F.length(F.lower(c)) == F.length(c), F.lower(c)).otherwise(c)


def _kind(v):
    return F.when(v.contains("@"), "mail").when(v.rlike(rf"^{IBAN}\z"), "iban").when(v.rlike(rf"^{HEX}\z"), "hex").when(v.rlike(rf"^{IP}\z"), "ip").otherwise("number")


def _norm(v, kind):
    return F.when(kind == "number", F.regexp_replace(v, r"[^\p{Nd}]", "")).when(kind == "iban", _lower(F.regexp_replace(v, " ", ""))).otherwise(_lower(v))


def _as(raw, new, kind):
    """The surrogate with the separators and capitals of the occurrence."""
    def step(acc, c):
        take = F.when(kind == "number", c.rlike(r"\p{Nd}")).when(kind == "iban", c != " ").otherwise(F.lit(True))
        n = F.substring(new, acc["j"], F.lit(1))
        n = F.when((F.lower(c) != c) & (F.length(F.upper(n)) == 1), F.upper(n)).otherwise(n)
        return F.struct((acc["j"] + take.cast("int")).alias("j"), F.concat(acc["out"], F.when(take, n).otherwise(c)).alias("out"))
    return F.aggregate(F.split(raw, ""), F.struct(F.lit(1).alias("j"), F.lit("").alias("out")), step)["out"]


def _tokens(h):
    return F.regexp_extract_all(h["v"], F.lit(TOKEN), F.lit(0))


def _sorted(m):
    """A match of PATTERN: what leads to a name, the entity, its kind (null for a capitalised word)."""
    form = m.rlike(r"[@:\p{Nd}]") | m.contains("-") & m.rlike(rf"^{HEX}\z")
    name = m.rlike(r"[ -]|^\P{Lu}") | m.rlike(rf"^(?iu:{_NAMES})\z")
    pre = F.when(~form & m.contains(" "), F.regexp_extract(m, rf"^{LEAD}", 0)).otherwise(F.lit(""))
    return F.struct(pre.alias("pre"), m.substr(F.length(pre) + 1, F.length(m)).alias("v"), F.when(form, _kind(m)).when(name, F.lit("name")).alias("kind"))


def _may_hold(text):
    """False only where no match of PATTERN is an entity: its formats, a title, cue or given name, or a script of CUED are needed."""
    return reduce(or_, [F.col(text).rlike(h) for h in HINTS])


def _found(d, wanted=None):
    """hits: of each match of PATTERN, what leads to it, value and what it is (an entity's kind, name, or null). Rows that are
    not ``wanted`` are not searched, their hits are null."""
    matches = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    every = F.transform(matches if wanted is None else F.when(wanted, matches), _sorted)
    words = lambda m: F.array_distinct(F.flatten(F.transform(F.filter(m, lambda x: x["kind"] == "name"), lambda x: F.transform(_tokens(x), _lower))))

    def hit(m, known):
        kind = F.when(m["kind"].isNotNull(), m["kind"]).when((F.size(known) > 0) & F.array_contains(known, _lower(m["v"])), F.lit("name"))
        return F.struct(m["pre"].alias("pre"), m["v"].alias("v"), kind.alias("kind"))
    # arrays of one element bind a value, else it would be computed again for each match
    bound = F.transform(F.array(every), lambda m: F.struct(m.alias("m"), words(m).alias("known")))
    return d.withColumn("hits", F.get(F.transform(bound, lambda x: F.transform(x["m"], lambda m: hit(m, x["known"]))), F.lit(0)))


def replace_entities(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """One row for each different (doc_id, text) of ``docs``: doc_id, row_key, n_entities and text with surrogates.

    Null texts stay null and have no entities. Repeated rows are one document, a null doc_id is one like others. Extra
    columns are ignored; an empty table gives an empty result. ``key`` is the secret of the draw.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.col("text"))
    rid = F.xxhash64("doc_id", "row_key")
    hits = F.filter("hits", lambda h: h["kind"].isNotNull())
    parts = lambda h: F.when(h["kind"] == "name", F.transform(_tokens(h), _lower)).otherwise(F.array(_norm(h["v"], h["kind"])))
    each = F.flatten(F.transform(hits, lambda h: F.transform(parts(h), lambda x: F.struct(h["kind"].alias("kind"), x.alias("norm")))))
    some = d.where(_may_hold("text")).distinct().withColumn("rid", rid)
    units = materialise(_found(some).select("rid", F.explode(F.array_distinct(each)).alias("u")).select("rid", "u.kind", "u.norm").distinct())
    names = materialise(_surrogates(units.select("kind", "norm").distinct(), key))
    drawn = units.join(names, ["kind", "norm"]).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws(" ", "kind", "norm"), F.struct("new", "given")))).alias("news"))

    def word(t):
        to = F.element_at("news", F.concat(F.lit("name "), _lower(t)))
        whole = F.when((F.upper(t) == t) & (F.length(t) > 1), F.upper(to["new"])).otherwise(F.initcap(F.regexp_replace(to["new"], "-", " ")))
        return F.when(to["given"], F.regexp_replace(whole, " ", "-")).otherwise(_as(t, to["new"], F.lit("name")))

    def replaced(h):
        toks = F.transform(_tokens(h), word)
        run = F.array_join(F.zip_with(F.split(h["v"], TOKEN, -1), toks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        to = F.element_at("news", F.concat(h["kind"], F.lit(" "), _norm(h["v"], h["kind"])))["new"]
        form = F.when(h["kind"] == "ip", to).otherwise(_as(h["v"], to, h["kind"]))
        return F.concat(h["pre"], F.when(h["kind"].isNull(), h["v"]).when(h["kind"] == "name", run).otherwise(form))
    j = d.distinct().withColumn("rid", rid).join(drawn, "rid", "left")
    j = _found(j, F.col("news").isNotNull())
    text = F.array_join(F.zip_with(F.split("text", PATTERN, -1), F.transform("hits", replaced),
                                   lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    n = F.when(F.col("news").isNull(), F.lit(0)).otherwise(F.size(hits))
    return j.select("doc_id", "row_key", n.alias("n_entities"), F.when(F.col("news").isNull(), F.col("text")).otherwise(text).alias("text"))
