"""Small documents with every odd case, and plain-Python versions of what the operators promise."""
import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row_key string, _doc string, id string, key string, "
          "kept string, size string, n string, component string, words string, hits string")


def frame(spark, rows):
    """rows: (doc_id, text, source). The other columns have names that operators use inside."""
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), *(["x"] * 10)) for d, t, s in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def vocabulary(n=400, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnoprstuvéß") for _ in range(r.randint(2, 9))) for _ in range(n)]


def prose(r, words, n):
    out = [r.choice(words) for _ in range(n)]
    return "".join(w + ("\n" if r.random() < 0.08 else " ") for w in out)


def documents(seed=3, n=60):
    r, v = random.Random(seed), vocabulary()
    common = "This Common Line of the License is Held by Many Documents, Émile."
    passage = " ".join(r.choice(v) for _ in range(60))
    base = prose(r, v, 150)
    rows = [(i, prose(r, v, r.choice([1, 3, 12, 40, 120, 300])), f"src{r.randint(0, 4)}") for i in range(n)]
    rows += [(100 + i, base, "src0") for i in range(4)]  # copies
    for i in range(12):  # near copies
        w = base.split(" ")
        for _ in range(i % 5):
            w[r.randrange(len(w))] = r.choice(v)
        rows.append((200 + i, " ".join(w), "src1"))
    rows += [(300 + i, f"{prose(r, v, 30)}\n{common if i % 2 else common.lower().replace('émile', 'Émile')}\n{prose(r, v, 9)} {passage} {prose(r, v, 20)}", "src2") for i in range(9)]
    rows += [(400, None, None), (401, "", "src3"), (402, " \t\n\x0b\n", None), (403, "one", "src3"), (404, "one", "src3"), (404, "one", "src3"),
             (405, "same same " * 60, "src4"), (406, prose(r, v, 9000), "src4"), (407, "\n\n" + common + "  \n" + common, "src4"),
             (408, "ÉCOLE école K k ſ", "src4"), (None, prose(r, v, 40), "src0"), (None, passage, "src1"),
             (409, prose(r, v, 50), "src2"), (409, prose(r, v, 50), "src2"), (410, base + " more", "src2"), (410, base + " more", "src2")]
    r.shuffle(rows)
    return rows


def sort_key(d):
    return (d is not None, d if d is not None else 0)


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    c = Counter(grams)
    rep = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(rep),
            len(w) < 10 or 100 * len(rep) > 20 * len(w))


def components(rows, k, percent=80):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall((t or "").translate(AZ))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        low[find(i)].append(d)
    least = {c: min((d for d in ds if d is not None), default=None) for c, ds in low.items()}
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _, _) in enumerate(rows)], [find(i) for i in range(len(rows))]


def decontaminated(rows, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    win = defaultdict(set)
    for item, t in items:
        w = word.findall((t or "").translate(AZ))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            win[tuple(w[i:i + width])].add(item)
    sizes = {len(g) for g in win}
    out = []
    for d, t, _ in rows:
        w = word.findall((t or "").translate(AZ))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i:i + n])) in win:
                    hit.update(range(i, i + n))
                    found |= win[g]
        out.append((d, len(w), sorted(hit), sorted(found)))
    return out


def phrases(rows, width=20, key=hash):
    """Rows that are equal count once and get equal results; rows of one doc_id go by key(text)."""
    once = sorted(set((d, t) for d, t, _ in rows), key=lambda x: (sort_key(x[0]), key(x[1])))
    seen, result = set(), {}
    for d, t in once:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - width + 1):
            g = tuple(w[i:i + width])
            if g in seen:
                gone.update(range(i, i + width))
            seen.add(g)
        result[d, t] = (d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return [result[d, t] for d, t, _ in rows]


def lines(rows, chars=40, docs=5):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(AZ)
    holders = defaultdict(set)
    for d, t, _ in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(d)
    out = []
    for d, t, _ in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if not (len(k := key(x)) >= chars and len(h := holders[k]) >= docs and d != max(h, key=sort_key))]
        out.append((d, len(ls), len(ls) - len(keep), sha("\n".join(keep))))
    return out
