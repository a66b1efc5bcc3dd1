"""LM scores against plain Python; surrogates keep format, coreference and distinctness."""
import math
import random
import re
from collections import Counter, defaultdict

import cases
import pytest
from pyspark.sql import functions as F

from assetlake.llm import lm_score, pii


def test_scores(spark, docs, rows, none):
    words = [cases.WORD.findall(t or "") for _, t, _ in rows]
    own = [Counter(tuple(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)) for w in words]
    total = sum(own, Counter())
    size = sum(map(len, words))
    want = defaultdict(list)
    for (d, _, _), w, mine in zip(rows, words, own):
        n = lambda g: total[tuple(g)] - mine[tuple(g)]  # noqa: B023, E731
        score = 0.0
        for i in range(len(w)):
            if i > 1 and n(w[i - 2:i + 1]):
                score += math.log(n(w[i - 2:i + 1]) / n(w[i - 2:i]))
            elif i > 0 and n(w[i - 1:i + 1]):
                score += math.log(0.4 * n(w[i - 1:i + 1]) / n(w[i - 1:i]))
            else:
                score += math.log(0.16 * max(1, n(w[i:i + 1])) / size)
        want[d, len(w)].append(score)
    for bounds in ({}, {"block_words": 700, "part_grams": 1000}):  # what a task holds does not change the scores
        got = defaultdict(list)
        for r in lm_score.score_documents(docs, **bounds).collect():
            got[r.doc_id, r.n_words].append(r.score)
        assert got.keys() == want.keys()
        assert all(sorted(got[k]) == pytest.approx(sorted(want[k]), abs=1e-4) for k in want)
    assert lm_score.score_documents(none).count() == 0
    empty = lm_score.score_documents(cases.frame(spark, [(1, None, "s"), (2, " ", "s"), (2, " ", "s")]), block_words=1).collect()
    assert sorted((r.doc_id, r.n_words, r.score) for r in empty) == [(1, 0, 0.0), (2, 0, 0.0), (2, 0, 0.0)]


def test_surrogates(spark, docs, none):
    texts = ["Mail Joe.Doe.12@mail0.example.com or 10.20.30.255, call 0123 456 789 now", "Joe.Doe.12@mail0.example.com!", None, "", "x 4785380592391135",
             " ".join(f"u{i}@a.org" for i in range(60)), "nothing here 12 34"]
    df = cases.frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in pii.replace_entities(df).collect()}
    assert [got[i].n_entities for i in range(7)] == [3, 1, 0, 0, 1, 60, 0]
    assert got[2].text is None and got[3].text == "" and got[6].text == texts[6]
    shape = lambda t: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", t)))
    assert shape(got[4].text[2:]) == shape(texts[4][2:]) and got[4].text != texts[4]
    mail = re.search(r"\S+@\S+", got[0].text)[0]
    assert got[1].text == mail + "!" and shape(mail) == shape("Joe.Doe.12@mail0.example.com") and mail.endswith(".com")
    assert all(int(x) < 256 for x in re.search(r"or ([0-9.]+),", got[0].text)[1].split("."))
    many = got[5].text.split()
    assert len(set(many)) == 60 and not set(many) & set(texts[5].split())
    assert pii.replace_entities(none).count() == 0 and pii.replace_entities(docs).count() == docs.select("doc_id", "text").distinct().count()


def test_surrogates_of_names_scripts_and_small_formats(spark):
    texts = ["Frau Anna Weiß, Анна", "Herr Weiß met ANNA and Weiß. Der Haus", "müller@x.de", "0123 456 789", "(0123456789)", "Joe@x.org", "joe@x.org",
             "DE89 3704 0044 0532 0130 00 and 00:1b:44:11:3a:b7", " ".join(f"{a}@{b}.de" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"), "Just Words Here"]
    t = {r.doc_id: r.text for r in pii.replace_entities(cases.frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    a = re.fullmatch(r"Frau (\S+) (\S+), (\S+)", t[0])
    b = re.fullmatch(r"Herr (\S+) met (\S+) and (\S+)\. Der Haus", t[1])
    table = {g: set(x.split()) for g, x in pii.GIVEN.items()}
    assert a[1].lower() in table["f latin"] - {"anna"} and a[3].lower() in table["f cyrillic"] - {"анна"}
    assert b[1] == b[3] == a[2] != "Weiß" and b[2] == a[1].upper()
    assert re.fullmatch(r"[^\W\d_]{6}@[a-z]\.de", t[2]) and not t[2].isascii() and "ller" not in t[2]
    assert t[3].replace(" ", "") == t[4].strip("()") != "0123456789" and t[5].lower() == t[6] != "joe@x.org" and t[5][0].isupper()
    assert t[7][:2] == "DE" and t[7] != texts[7] and re.fullmatch(r"([0-9a-f]{2}:){5}[0-9a-f]{2}", t[7].split()[-1])
    full, was = t[8].split(), texts[8].split()
    assert len(set(full)) == len(was) and all(x != y for x, y in zip(full, was)) and t[9] == texts[9]


def test_only_texts_with_a_hint_are_searched(spark):
    """A hint is in every text that holds an entity, and in every character of the scripts of cued names."""
    r = random.Random(8)
    parts = ["Anna", "anna", "Anna5", "Hansa", "ſarah", "\u212aarl", "Élodie", "Mr", "mr.", "Dr", "don", "my name is", "Ich heiße", "κ", "г-н", "Smith", "Иван", "von", "السيد", "محمد", "王", "先生",
             "a@b.de", "é.x@ü-y.gr", "@", "1.2.3.4", "1.2", "12", "٣٤", "123456789", "+49 (30) 123-456-789", "١٢٣٤٥٦٧٨٩", "DE44", "5001 0517 5407 3249 31", "DE44500105175407324931",
             "aa:bb:cc:dd:ee:ff", "AA-BB-CC-DD-EE-FF", "1:2:3:4:5:6:7:8", "made-by", "x", "Word", "’", "'s", "_", "-", ".", "\n"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randrange(1, 6))) for _ in range(6000)]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    holds = F.size(F.filter("hits", lambda h: h["kind"].isNotNull())) > 0
    n = pii._found(d).select(holds.alias("holds"), pii._may_hold("text").alias("hint")).groupBy("holds", "hint").count().collect()
    n = {(x.holds, x.hint): x["count"] for x in n}
    assert n[True, True] > 2000 and n[False, False] > 500 and (True, False) not in n
    assert pii._found(d, F.lit(False)).where("hits is not null").count() == 0
    letters = spark.createDataFrame([(chr(c),) for c in [*range(0x20, 0xD800), *range(0xE000, 0x30000)]], "text string")
    assert letters.where(F.col("text").rlike(r"[\p{IsArabic}\p{IsHebrew}\p{IsHan}]") & ~F.col("text").rlike(pii.HINTS[2])).count() == 0


def test_only_texts_with_a_hint_move_before_surrogates_are_drawn(spark, monkeypatch):
    texts = [f"plain words number {k} without any" for k in range(50)] + ["write to a@b.de", "write to a@b.de", None]
    seen = []
    real = pii._found
    monkeypatch.setattr(pii, "_found", lambda d, *more: seen.append(d.select("text").collect()) or real(d, *more))
    out = {x.doc_id: x for x in pii.replace_entities(cases.frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [len(x) for x in seen] == [2, 53]
    assert [out[i].n_entities for i in (0, 50, 51, 52)] == [0, 1, 1, 0] and out[50].text == out[51].text != texts[50]
