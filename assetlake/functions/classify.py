"""Class and lossy-unsafe flag of an asset from its property names."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake.fixed import CLASS_KEYWORDS, CLASS_ORDER, DATA_CLASSES, RISKY_WORDS


def property_rank(prop: Column, rules=CLASS_KEYWORDS) -> Column:
    """Priority of one property: 0 is the first class of ``rules``, len(rules) means no hit.

    The class of an asset is the class at the *minimum* rank over its properties, so it can be
    computed with a partial aggregate instead of gathering property lists."""
    low = F.lower(F.coalesce(prop, F.lit("")))
    rank = F.lit(len(rules))
    for i in range(len(rules) - 1, -1, -1):
        hit = F.lit(False)
        for word in rules[i][1]:
            hit = hit | low.contains(word)
        rank = F.when(hit, F.lit(i)).otherwise(rank)
    return rank


def class_at(rank: Column, rules=CLASS_KEYWORDS) -> Column:
    """Class name for a rank; a missing rank (asset without properties) is 'other'."""
    names = [c for c, _ in rules] + ["other"]
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.coalesce(rank, F.lit(len(rules))) + 1)


def classify(props: Column, rules=CLASS_KEYWORDS) -> Column:
    """P1 on an array of property names."""
    ranks = F.transform(F.coalesce(props, F.array().cast("array<string>")), lambda p: property_rank(p, rules))
    return class_at(F.array_min(ranks), rules)


def risky_property(prop: Column) -> Column:
    hit = F.lit(False)
    for word in RISKY_WORDS:
        hit = hit | prop.contains(word)
    return F.coalesce(hit, F.lit(False))


def is_risky(props: Column) -> Column:
    """P2 on an array of property names; case-sensitive, height words do not count."""
    return F.coalesce(F.exists(props, risky_property), F.lit(False))


def class_ord(cls: Column) -> Column:
    """0-based position of a class in the report order (unknown classes last)."""
    pos = F.array_position(F.array(*[F.lit(c) for c in CLASS_ORDER]), cls).cast("int")
    return F.when(pos > 0, pos - 1).otherwise(F.lit(len(CLASS_ORDER)))


def is_data_class(cls: Column) -> Column:
    return cls.isin(*DATA_CLASSES)


def only_hit(prop: Column, subs) -> Column:
    """R5 on one property: contains any of the (lower-case) substrings."""
    low = F.lower(F.coalesce(prop, F.lit("")))
    hit = F.lit(False)
    for s in subs:
        hit = hit | low.contains(s)
    return hit


def only_filter(props: Column, subs) -> Column:
    """R5 on an array of property names."""
    return F.coalesce(F.exists(props, lambda p: only_hit(p, subs)), F.lit(False))
