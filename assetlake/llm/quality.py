"""Quality rules as a short-circuit cascade.

Each rule is a test on one text. On a bounded sample every rule runs on every text, which gives its cost and the share it
rejects; rules are then ordered by rejection per cost, and the full pass stops at the first rule that rejects a text.
The verdict does not depend on the order, only the time does.
"""
import operator
import time
from collections import Counter
from functools import cached_property
from string import ascii_letters, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import WS, gram_hashes, row_key, whole

SYMBOLS = "#*$%&|<>"
CAPITALS = ascii_uppercase.encode()
NOT_LATIN = bytes(c for c in range(256) if chr(c) not in ascii_letters + WS)
NOT_LETTERS = bytes(c for c in NOT_LATIN if c < 128)  # every other script counts as letters


class Text:
    """A text with its words, lines and counts, each made once."""

    def __init__(self, text: str):
        self.text, self.raw = text, text.encode()
        self.words = self.raw.split()
        self.n = len(self.words)

    def words_of(self, others: bytes) -> list:
        """What is left of each word without the bytes of ``others``, for words of which something is left."""
        return self.raw.translate(None, others).split()

    @cached_property
    def lines(self):
        return [x for x in self.text.split("\n") if x.strip(WS)]

    @cached_property
    def chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, WS))

    @cached_property
    def symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def duplicate_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def repeated(self) -> int:
        """Words inside five-word windows that the text holds twice or more."""
        if self.n < 6:
            return 0
        h = gram_hashes(np.fromiter(map(hash, self.words), np.int64, self.n).view(np.uint64), 5)
        s = np.sort(h)
        same = s[1:] == s[:-1]
        if not same.any():
            return 0
        cover = np.zeros(self.n + 1, np.int64)
        starts = np.flatnonzero(np.isin(h, s[1:][same]))
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + 5, -1)
        return int(np.count_nonzero(np.cumsum(cover[:-1])))

    def base(self) -> list:
        """What every row shows: words, their characters, symbols, repeated lines, words in repeated windows."""
        return [self.n, self.chars, self.symbols, self.duplicate_lines, self.repeated()]


# Each rule: true when the text is to go. Limits are whole numbers so that SQL gives the same verdicts.
def many_symbols(t):
    return 10 * t.symbols > t.n


def shouting(t):
    """Most words have two capitals or more and no small letter. Those words alone would make more capitals than words."""
    if len(t.raw) - len(t.raw.translate(None, CAPITALS)) <= t.n:
        return False
    return 2 * sum(len(w) > 1 and w.isupper() for w in t.words_of(NOT_LATIN)) > t.n


def repeated_lines(t):
    return 2 * t.duplicate_lines > len(t.lines)


def odd_word_length(t):
    return t.chars < 2 * t.n or t.chars > 15 * t.n


def few_letters(t):
    return 2 * len(t.words_of(NOT_LETTERS)) < t.n


def ellipsis_lines(t):
    return 10 * sum(x.rstrip(WS).endswith(("...", "…")) for x in t.lines) > 3 * len(t.lines)


def bullet_lines(t):
    return 10 * sum(x.lstrip(WS).startswith(("-", "*", "•")) for x in t.lines) > 9 * len(t.lines)


def one_word(t):
    return t.n > 0 and 2 * max(Counter(t.words).values()) > t.n


def echoes(t):
    return 10 * sum(map(operator.eq, t.words[1:], t.words)) > 3 * t.n


RULES = {"many_symbols": many_symbols, "shouting": shouting, "repeated_lines": repeated_lines,
         "odd_word_length": odd_word_length, "few_letters": few_letters, "ellipsis_lines": ellipsis_lines,
         "bullet_lines": bullet_lines, "one_word": one_word, "echoes": echoes}


def rule_statistics(docs: DataFrame, rules=None, sample_rows: int = 2000, seed: int = 11) -> list[dict]:
    """Cost (nanoseconds a text) and share rejected of each rule, on a random sample of about ``sample_rows`` texts. The
    sample only orders the rules. Without texts every rule has cost 1 and share 0."""
    rules = rules or RULES

    def run(batches):
        spent, gone, n = Counter(), Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n, t = n + 1, Text(text)
                t.base()  # as in the full pass, rules find these counts made
                for name, rule in rules.items():
                    at = time.perf_counter_ns()
                    gone[name] += rule(t)
                    spent[name] += time.perf_counter_ns() - at
        yield pa.RecordBatch.from_pydict({"rule": list(rules), "n": [n] * len(rules), "ns": [spent[r] for r in rules],
                                          "gone": [int(gone[r]) for r in rules]})

    n = docs.count()
    few = docs.select(whole().alias("text"))
    few = few.sample(min(1.0, sample_rows / n), seed) if n > sample_rows else few
    got = few.mapInArrow(run, "rule string, n long, ns long, gone long").groupBy("rule").agg(
        F.sum("n").alias("n"), F.sum("ns").alias("ns"), F.sum("gone").alias("gone")).collect()
    by = {r["rule"]: r for r in got}
    out = []
    for name in rules:
        r = by.get(name)
        seen = r["n"] if r else 0
        out.append({"rule": name, "cost": r["ns"] / seen if seen else 1.0, "rejects": r["gone"] / seen if seen else 0.0})
    return out


def cascade_order(statistics: list[dict]) -> list[str]:
    """Rules by rejection per cost, the best first; ties by name."""
    return [s["rule"] for s in sorted(statistics, key=lambda s: (-s["rejects"] / max(s["cost"], 1e-9), s["rule"]))]


RESULT = ("doc_id long, row_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")


def _judge(order, rules, text):
    t = Text(text)
    base = t.base()
    repeat = base[-1]
    if t.n < 10 or 100 * repeat > 20 * t.n:
        return [*base, True, False, "base"]
    by = next((name for name in order if rules[name](t)), None)
    return [*base, False, by is None, by]


def quality_rules(docs: DataFrame, rules=None, sample_rows: int = 2000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, row_key, the base counts, base_failed, kept, and rejected_by (the rule of
    the cascade that rejected it first; it depends on measured costs, so it may differ between runs).

    Null and empty texts have no words, so they fail the base. Repeated rows and a null doc_id are judged like others.
    Extra columns are ignored.
    """
    rules = rules or RULES
    order = cascade_order(rule_statistics(docs, rules, sample_rows))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), whole().alias("text"))
    names = [c.split()[0] for c in RESULT.split(", ")][2:]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = [_judge(order, rules, text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)] + [pa.array([r[i] for r in rows], types[i]) for i in range(len(types))],
                names=["doc_id", "row_key", *names])

    return d.mapInArrow(run, RESULT)


def judge_column(docs: DataFrame, rules=None, sample_rows: int = 2000):
    """The cascade's verdict as a column on ``text``: true for texts that stay."""
    rules = rules or RULES
    order = cascade_order(rule_statistics(docs, rules, sample_rows))

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([_judge(order, rules, t)[6] for t in texts], dtype=bool)

    return kept(whole())
