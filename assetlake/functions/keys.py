"""P3, P4, P5, P12 (owners), P14: owner and group keys."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake import fixed as K


def trim_space(c: Column) -> Column:
    """Without white space of any script at both ends (F.trim takes only U+0020)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def _names(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def owner_key(obj_type: Column, slot: Column) -> Column:
    return (F.when(obj_type == K.OBJ_ACCESSORY, F.lit(K.ACCESSORY_BASE) + slot)
            .when(obj_type >= 3, F.lit(K.BODY_BASE) + slot)
            .otherwise(slot)).cast("int")


def owner_type(key: Column) -> Column:
    return (F.when(key >= K.BODY_BASE, F.lit(K.OBJ_BODY))
            .when(key >= K.ACCESSORY_BASE, F.lit(K.OBJ_ACCESSORY))
            .otherwise(F.lit(K.OBJ_CLOTHES)))


def owner_index(key: Column) -> Column:
    return (F.when(key >= K.BODY_BASE, key - K.BODY_BASE)
            .when(key >= K.ACCESSORY_BASE, key - K.ACCESSORY_BASE)
            .otherwise(key)).cast("int")


def group_of(obj_type: Column, coord: Column) -> Column:
    """Body types and negative coordinates belong to group 0; a missing coordinate counts as 0."""
    c = F.coalesce(coord, F.lit(0))
    return F.when((obj_type >= 3) | (c < 0), F.lit(K.BODY_GROUP)).otherwise(c + 1).cast("int")


def pack_group(group: Column, key: Column) -> Column:
    return ((group + 1) * K.GROUP_BASE + key).cast("int")


def is_group_key(key: Column) -> Column:
    return key >= K.GROUP_BASE


def key_group(key: Column) -> Column:
    return (F.floor(key / K.GROUP_BASE) - 1).cast("int")


def key_slot(key: Column) -> Column:
    return (key % K.GROUP_BASE).cast("int")


def owner_token(key: Column) -> Column:
    """Machine token of an owner key without group: top, acc3, bodyparts0, slot12."""
    return (F.when(key >= K.BODY_BASE, F.concat(F.lit("bodyparts"), key - K.BODY_BASE))
            .when(key >= K.ACCESSORY_BASE, F.concat(F.lit("acc"), key - K.ACCESSORY_BASE))
            .otherwise(F.coalesce(F.get(_names(K.SLOT_TOKENS), key), F.concat(F.lit("slot"), key))))


def slot_name(key: Column) -> Column:
    return (F.when(key >= K.BODY_BASE, F.lit(K.BODY_NAME))
            .when(key >= K.ACCESSORY_BASE, F.concat(F.lit(K.ACCESSORY_SLOT_PREFIX), key - K.ACCESSORY_BASE))
            .otherwise(F.coalesce(F.get(_names(K.SLOT_NAMES), key), F.concat(F.lit(K.CLOTHES_SLOT_PREFIX), key))))


def group_name(group: Column) -> Column:
    return F.when(group <= K.BODY_GROUP, F.lit(K.BODY_GROUP_NAME)).otherwise(
        F.coalesce(F.get(_names(K.GROUP_NAMES), group - 1), F.concat(F.lit(K.GROUP_PREFIX), group)))


def group_slot_name(group: Column, key: Column) -> Column:
    return F.concat(group_name(group), F.lit(K.GROUP_SLOT_SEPARATOR), slot_name(key))


def owner_name(key: Column) -> Column:
    """Display name; group keys show group and slot. Give it a plain column: it refers to it often."""
    return F.when(is_group_key(key), group_slot_name(key_group(key), key_slot(key))).otherwise(slot_name(key))


def owner_order(key: Column) -> Column:
    """Position of an owner in reports: clothes, then accessories, then body, inside its group."""
    slot = F.when(is_group_key(key), key_slot(key)).otherwise(key)
    base = F.when(is_group_key(key), key_group(key) * K.GROUP_BASE).otherwise(F.lit(0))
    pos = (F.when(slot >= K.BODY_BASE, F.lit(100000) + slot - K.BODY_BASE)
           .when(slot >= K.ACCESSORY_BASE, F.lit(100) + slot - K.ACCESSORY_BASE)
           .otherwise(slot))
    return (base + pos).cast("long")


def owner_from_token(token: Column) -> Column:
    """Digits, acc<n>, or the first slot whose display name contains the text; else -1."""
    t = F.lower(trim_space(token))
    digits = F.regexp_replace(t, "[^0-9]", "")
    found = F.lit(-1)
    for i in range(len(K.SLOT_NAMES) - 1, -1, -1):
        found = F.when(F.lit(K.SLOT_NAMES[i]).contains(t), F.lit(i)).otherwise(found)
    return (F.when(t.rlike("^[0-9]+$"), t.try_cast("int"))
            .when(t.startswith("acc") & (digits != ""), F.lit(K.ACCESSORY_BASE) + digits.try_cast("int"))
            .otherwise(found)).cast("int")


def group_token(token: Column) -> Column:
    """Group number named by one list entry (body, g3, 5), NULL when it names none in 0..30."""
    t = F.lower(trim_space(token))
    n = F.regexp_replace(t, "^g", "").try_cast("int")
    g = F.when(t.isin(*K.BODY_WORDS), F.lit(0)).otherwise(n)
    return F.when((g >= 0) & (g <= K.MAX_MASK_GROUP), g)


def group_mask(tokens: Column) -> Column:
    """Bit mask of a token array; an empty list or a lone 'all' means no limit (0)."""
    whole = F.lower(trim_space(F.array_join(tokens, ",")))
    bits = F.aggregate(
        tokens, F.lit(0),
        lambda acc, t: acc.bitwiseOR(F.coalesce(_bit(group_token(t)), F.lit(0))))
    return F.when(whole.isin("", "all"), F.lit(0)).otherwise(bits)


def _bit(group: Column) -> Column:
    """1 << group for a column shift amount: the shift amount of F.shiftleft must be a literal."""
    return F.call_function("shiftleft", F.lit(1), group)


def group_in_mask(group: Column, mask: Column) -> Column:
    """One owner group against a mask; groups beyond 30 can never be in one."""
    inside = mask.bitwiseAND(_bit(F.greatest(F.least(group, F.lit(30)), F.lit(0)))) != 0
    return (group >= 0) & (group <= K.MAX_MASK_GROUP) & inside


def in_mask(groups: Column, mask: Column) -> Column:
    """Every owner group must be in the mask; mask 0 is no limit, no owners pass."""
    return (mask == 0) | F.coalesce(F.forall(groups, lambda g: group_in_mask(g, mask)), F.lit(True))
