"""Secret scans by grammar inference.

Fixed patterns find labelled credentials. From a bounded sample of them a probabilistic automaton is inferred for each
kind: the prefix tree of the examples, whose states are merged where their outgoing and ending frequencies are compatible
(Hoeffding test, also for all states below). One more is inferred from ordinary tokens. Every token of eight and more
characters, and what is left of one beside a base span, is then scored by its likelihood: it becomes a span of kind
"inferred" if it fits a format as well as the examples do and far better than it fits ordinary tokens.

The texts are read twice, for the examples and for the spans; no candidates are stored between.
"""
import heapq
import math
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import materialise, row_key, whole

KINDS = ["assign", "access", "hex", "inferred"]
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is what remains of all runs
HINTS = ("passw", "secret", "token", "api")
SHORTEST = 8  # characters of a candidate, as of a labelled value
TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % SHORTEST)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, credential) in order."""
    out, longest = [], max(map(len, text.split()), default=0)
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if longest >= 16:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if longest >= 32:
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base) -> list[tuple[int, int, str]]:
    """(start, end, token) of all tokens of SHORTEST and more characters; of tokens that base spans touch, the pieces beside
    them that are long enough."""
    out = []
    for m in TOKEN.finditer(text):
        at = m.start()
        if base:
            for start, _, end, _ in base:
                if start < m.end() and end > at:
                    if start - at >= SHORTEST:
                        out.append((at, start, text[at:start]))
                    at = max(at, end)
        if m.end() - at >= SHORTEST:
            out.append((at, m.end(), text[at:m.end()]))
    return out


CLASSES = {c: (k, len(chars)) for k, chars in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ",
                                                         "+", "/", "_", "=", ".", "-")) for c in chars}
SYMBOLS = 11
#: A token may fit worse than all but a hundredth of the examples by so much a character (shorter ones vary more).
MARGIN = 0.1


class Automaton:
    """A probabilistic automaton over character classes; characters of a class are equally likely."""

    def __init__(self, steps, ends, totals, floor=0.0):
        self.steps, self.ends, self.totals, self.floor = steps, ends, totals, floor

    @classmethod
    def infer(cls, examples: list[str], alpha: float = 0.05):
        """Merge compatible states of the examples' prefix tree, nearest to the root first."""
        steps, count, ends, totals = [{}], [{}], [0], [0]
        for text in examples:
            q = 0
            for ch in text:
                k = CLASSES[ch][0]
                totals[q] += 1
                if k not in steps[q]:
                    steps[q][k] = len(steps)
                    for new, empty in ((steps, {}), (count, {}), (ends, 0), (totals, 0)):
                        new.append(empty)
                count[q][k] = count[q].get(k, 0) + 1
                q = steps[q][k]
            totals[q] += 1
            ends[q] += 1
        bound = math.sqrt(0.5 * math.log(2 / alpha))

        def differ(a, n, b, m):
            return abs(a / n - b / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

        def compatible(p, q):
            todo = [(p, q)]
            while todo:
                p, q = todo.pop()
                if p == q:
                    continue
                n, m = totals[p], totals[q]
                if differ(ends[p], n, ends[q], m):
                    return False
                for k in steps[p].keys() | steps[q].keys():
                    if differ(count[p].get(k, 0), n, count[q].get(k, 0), m):
                        return False
                    if k in steps[p] and k in steps[q]:
                        todo.append((steps[p][k], steps[q][k]))
            return True

        def fold(p, q):
            """Adds the tree below q to p."""
            todo = [(p, q)]
            while todo:
                p, q = todo.pop()
                totals[p] += totals[q]
                ends[p] += ends[q]
                for k, to in steps[q].items():
                    count[p][k] = count[p].get(k, 0) + count[q][k]
                    if k in steps[p]:
                        todo.append((steps[p][k], to))
                    else:
                        steps[p][k] = to

        settled, waiting = [0], [(0, k) for k in sorted(steps[0])]
        while waiting:
            p, k = waiting.pop(0)
            q = steps[p][k]
            if q in settled:
                continue
            same = next((s for s in settled if compatible(s, q)), None)
            if same is None:
                settled.append(q)
                waiting += [(q, x) for x in sorted(steps[q])]
            else:
                steps[p][k] = same
                fold(same, q)
                waiting = [(s, x) for s in settled for x in sorted(steps[s]) if steps[s][x] not in settled]
        at = {q: i for i, q in enumerate(settled)}
        a = cls([{k: (at[to], count[q][k]) for k, to in steps[q].items()} for q in settled], [ends[q] for q in settled], [totals[q] for q in settled])
        scores = sorted(a.score(x) for x in examples)
        a.floor = scores[len(scores) // 100] - MARGIN if scores else math.inf
        return a

    def score(self, text: str) -> float:
        """Log likelihood for a character; steps that no example took have a small share and end the walk's knowledge."""
        q, total = 0, 0.0
        for ch in text:
            k, size = CLASSES[ch]
            n = self.totals[q]
            to, seen = self.steps[q].get(k, (q, 0))
            total += math.log((seen + 0.01) / (n + 0.01 * (SYMBOLS + 1)) / size)
            q = to
        total += math.log((self.ends[q] + 0.01) / (self.totals[q] + 0.01 * (SYMBOLS + 1)))
        return total / (len(text) + 1)


#: Log likelihood for a character of a token drawn evenly from all characters: formats must beat it where nothing is known
#: of ordinary tokens.
EVEN = -math.log(len(CLASSES))
#: How much likelier (as a logarithm) a whole token must be under a format than among ordinary tokens.
ODDS = math.log(1000)
#: Ordinary tokens in the sample, and different ones that teach at least what is ordinary.
ORDINARY, FEWEST = 1000, 100
#: Shapes (tokens with each character's class in its place) whose verdict a task remembers; scores depend on nothing else.
REMEMBERED = 200_000
SHAPE = str.maketrans({c: "0123456789:"[k] for c, (k, _) in CLASSES.items()})


def fits(token: str, models, ordinary=None) -> bool:
    usual = EVEN
    if ordinary:  # a word in capitals is as ordinary as in small letters
        usual = max(ordinary.score(token), ordinary.score(token.lower()) if token.isupper() else -math.inf) + ODDS / (len(token) + 1)
    return any(s >= m.floor and s > usual for m in models for s in [m.score(token)])


class Smallest:
    """The distinct values of smallest hash, at most ``limit``; any two such samples merge into that of both."""

    def __init__(self, limit):
        self.limit, self.heap, self.held = limit, [], set()

    def add(self, value):
        if value in self.held:
            return
        item = (2**63 - 1 - xxhash.xxh3_64_intdigest(value), value)
        if len(self.heap) < self.limit:
            heapq.heappush(self.heap, item)
        elif item > self.heap[0]:
            self.held.discard(heapq.heapreplace(self.heap, item)[1])
        else:
            return
        self.held.add(value)

    def rows(self):
        """(hash, value): the smallest hashes are those of the heap's largest items."""
        return [(-h, v) for h, v in self.heap]


def _examples(limits):
    """A sample of each kind's labelled values and (the last kind) of ordinary tokens from each task."""
    def run(batches):
        samples = [Smallest(n) for n in limits]
        for batch in batches:
            for text in batch.column(0).to_pylist():
                base = base_spans(text)
                for _, kind, _, value in base:
                    samples[kind].add(value)
                for value in {c[2] for c in candidates(text, base)}:
                    samples[-1].add(value)
        rows = [(k, *r) for k, s in enumerate(samples) for r in s.rows()]
        kind, hashed, value = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(hashed, pa.int64()), pa.array(value, pa.string())],
                                         names=["kind", "hash", "value"])
    return run


def infer_formats(texts: DataFrame, max_examples: int = 400, max_ordinary: int = ORDINARY):
    """texts (text): one automaton for each of the base kinds, from its ``max_examples`` distinct values of smallest hash, and
    one for ordinary tokens, from ``max_ordinary`` distinct tokens beside base spans (the bounds of the sample; a task
    keeps and hands over no more). Kinds with fewer than five values teach nothing, nor do fewer than FEWEST ordinary tokens."""
    limits = [max_examples] * 3 + [max_ordinary]
    seen = materialise(texts.mapInArrow(_examples(limits), "kind int, hash long, value string"))
    got = [sorted(r.value for r in seen.where(F.col("kind") == k).select("hash", "value").distinct().orderBy("hash", "value").limit(n).collect())
           for k, n in enumerate(limits)]
    models = [Automaton.infer(v) for v in got[:3] if len(v) >= 5]
    return models, Automaton.infer(got[3]) if len(got[3]) >= FEWEST else None


SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
SCAN = ("doc_id long, row_key long, base array<struct<kind:int,start:long,end:long,value:string>>, "
        "inferred array<struct<kind:int,start:long,end:long,value:string>>")


def _scan(models, ordinary):
    def run(batches):
        known = {}
        for batch in batches:
            base, inferred = [], []
            for text in batch.column(2).to_pylist():
                b, found = base_spans(text), []
                for start, end, token in candidates(text, b) if models else ():
                    shape = token.translate(SHAPE)
                    hit = known.get(shape)
                    if hit is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        hit = known[shape] = fits(token, models, ordinary)
                    if hit:
                        found.append({"kind": 3, "start": start, "end": end, "value": token})
                base.append([{"kind": k, "start": s, "end": e, "value": v} for s, k, e, v in b])
                inferred.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, SPAN), pa.array(inferred, SPAN)],
                                             names=["doc_id", "row_key", "base", "inferred"])
    return run


def find_secrets(docs: DataFrame, max_examples: int = 400, max_ordinary: int = ORDINARY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, row_key, base and inferred, both arrays of (kind, start, end, value) with
    offsets in characters; kind is a number in KINDS.

    Null and empty texts have no spans. Repeated rows and a null doc_id are scanned like others. Without labelled
    credentials nothing is inferred. Extra columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), whole().alias("text"))
    return d.mapInArrow(_scan(*infer_formats(d.select("text"), max_examples, max_ordinary)), SCAN)
