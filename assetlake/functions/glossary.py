"""P20 inside tasks: a glossary cut after the first characters of its terms, and the terms that stand in a text."""
import re
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BRANCHES = 50  # of the pattern that finds places


def _begin(heads):
    """Matches the first character of each place whose first two characters begin some head."""
    nexts = {}
    for head in heads:
        nexts.setdefault(head[0], set()).add(head[1:2])
    groups = {}
    for first, seconds in nexts.items():
        groups.setdefault("" if "" in seconds else "".join(map(re.escape, sorted(seconds))), []).append(re.escape(first))
    if not groups:
        return re.compile("(?!)")
    if len(groups) > BRANCHES:
        groups = {"": sum(groups.values(), [])}
    return re.compile("|".join("[" + "".join(firsts) + "]" + (f"(?=[{seconds}])" if seconds else "") for seconds, firsts in groups.items()))


class Heads:
    """Heads (the first characters of terms) with the lengths of the terms that begin so, the longest first."""

    def __init__(self, lengths: dict):
        self.lengths = {head: sorted(ns, reverse=True) for head, ns in lengths.items()}
        self.sizes = sorted({len(head) for head in lengths}, reverse=True)
        self.begin = _begin(lengths)


def asked(t: str, heads: Heads, longer: int) -> list:
    """Different strings of more than ``longer`` characters in the text that may be terms."""
    out, end = set(), len(t)
    for m in heads.begin.finditer(t):
        i = m.start()
        for size in heads.sizes:
            out.update(t[i:i + n] for n in heads.lengths.get(t[i:i + size], ()) if n > longer and i + n <= end)
    return list(out)


def replaced(t: str, heads: Heads, known: dict, more: dict = {}) -> str:
    """The text with the longest term at each place replaced by its target in ``known`` or ``more``, from left to right."""
    out, done, lengths, sizes = [], 0, heads.lengths.get, heads.sizes
    for m in heads.begin.finditer(t):
        i = m.start()
        if i < done:
            continue
        for s in (t[i:i + n] for size in sizes for n in lengths(t[i:i + size], ())):  # near the end of a text shorter than n
            if s in known or s in more:
                out += [t[done:i], known[s] if s in known else more[s]]
                done = i + len(s)
                break
    return "".join(out) + t[done:]
