"""Pieces of oracle SQL generated from the fixed word lists."""
from assetlake import fixed as K


def q(s):
    return "'" + s.replace("'", "''") + "'"


def class_rank(p):
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains(lower({p}), {q(w)})' for w in words)} THEN {i}"
        for i, (_, words) in enumerate(K.CLASS_KEYWORDS))
    return f"CASE {whens} ELSE {len(K.CLASS_KEYWORDS)} END"


def class_at(rank):
    whens = " ".join(f"WHEN {i} THEN {q(c)}" for i, (c, _) in enumerate(K.CLASS_KEYWORDS))
    return f"CASE {rank} {whens} ELSE 'other' END"


def class_ord(c):
    whens = " ".join(f"WHEN {q(n)} THEN {i}" for i, n in enumerate(K.CLASS_ORDER))
    return f"CASE {c} {whens} ELSE {len(K.CLASS_ORDER)} END"


def risky(p):
    return "(" + " OR ".join(f"contains({p}, {q(w)})" for w in K.RISKY_WORDS) + ")"


def token(k):
    whens = " ".join(f"WHEN {k} = {i} THEN {q(t)}" for i, t in enumerate(K.SLOT_TOKENS))
    return (f"CASE WHEN {k} >= 2000 THEN 'bodyparts' || ({k} - 2000) WHEN {k} >= 1000 THEN 'acc' || ({k} - 1000) "
            f"{whens} ELSE 'slot' || {k} END")


def slot_name(k):
    whens = " ".join(f"WHEN {k} = {i} THEN {q(t)}" for i, t in enumerate(K.SLOT_NAMES))
    return (f"CASE WHEN {k} >= 2000 THEN {q(K.BODY_NAME)} "
            f"WHEN {k} >= 1000 THEN {q(K.ACCESSORY_SLOT_PREFIX)} || ({k} - 1000) "
            f"{whens} ELSE {q(K.CLOTHES_SLOT_PREFIX)} || {k} END")


def group_name(g):
    whens = " ".join(f"WHEN {g} = {i + 1} THEN {q(t)}" for i, t in enumerate(K.GROUP_NAMES))
    return f"CASE WHEN {g} <= 0 THEN {q(K.BODY_GROUP_NAME)} {whens} ELSE {q(K.GROUP_PREFIX)} || {g} END"


def owner_name(k):
    g, s = f"({k} // 100000 - 1)", f"({k} % 100000)"
    grouped = f"({group_name(g)}) || {q(K.GROUP_SLOT_SEPARATOR)} || ({slot_name(s)})"
    return f"CASE WHEN {k} >= 100000 THEN {grouped} ELSE ({slot_name(k)}) END"


def norm_material(c):
    return f"regexp_replace({c}, '(?is)^(.+)\\.MECopy[0-9]*$', '\\1')"


def sig(key, material, prop):
    return f"({token(key)}) || '|' || {norm_material(material)} || '|' || {prop}"


def human(n):
    def s(p, u):
        return f"printf('%.2f {u}', round({n}::DOUBLE / {1024 ** p}, 2))"
    return (f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < {1024 ** 2} THEN {s(1, 'KB')} "
            f"WHEN {n} < {1024 ** 3} THEN {s(2, 'MB')} ELSE {s(3, 'GB')} END")


def fmt_rank(f):
    return f"CASE {f} WHEN 'keep' THEN 0 WHEN 'png' THEN 1 WHEN 'auto' THEN 2 WHEN 'jpeg' THEN 3 WHEN 'jpg' THEN 3 ELSE 2 END"


def rank_fmt(r):
    return f"CASE {r} WHEN 0 THEN 'keep' WHEN 1 THEN 'png' WHEN 2 THEN 'auto' ELSE 'jpeg' END"


def clamp(v):
    return f"greatest(least({v}, 255), 0)"


def near(v):
    return f"round({v}, 6)"
