"""Substring dedup with repeated-phrase automata.

A window of 20 words is represented by its seed, the smallest hash of its six-word runs: equal windows have equal seeds,
and neighbouring windows mostly share one, so a text has one seed for about eight words.

1. Texts with equal words are one class; all but the first of a class go whole, the first goes on.
2. Seeds found in two classes, or twice in one text, may belong to repeated windows. Rows (seed, class) are
   range-partitioned and sorted by both and streamed, so a very frequent seed spreads over partitions.
3. For these seeds alone, the stretches of text whose windows have the seed (segments) are dealt out by seed; a seed with
   many segments is dealt over several salts. A task reads its groups in document order. Hashes only propose: windows
   that recur, and that never occur without one another, make one passage, so each lies in one passage. The words of
   each different passage become a pattern of the shard's Aho-Corasick automaton; every segment that came to the shard is
   streamed through it, and what it locates decides: all occurrences of a passage in a group after the first one are
   covered. Of a salted seed, the windows not covered in their salt are compared once more.
4. Covered words leave the text.
"""
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import WordHashes, gram_hashes, materialise, row_key, scramble, whole

#: Words of a run whose hash may become a seed.
RUN = 6
#: Segments of one (seed, salt) group, about, and of one shard's automaton, at least.
GROUP, SHARD = 1024, 8192
KEYS = ["doc_id", "row_key"]


def smallest_runs(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs, and the seed of each window (its smallest run hash)."""
    runs = gram_hashes(words, RUN)
    span = width - RUN + 1
    low, have = runs, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:len(low) - step], low[step:])
        have += step
    return runs, low


def _digests(width):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            n, c, sha, seeds, often = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                words = text.encode().split()
                flat = b" ".join(words)
                n.append(len(words))
                c.append(np.frombuffer(xxhash.xxh3_128_digest(flat), np.int64))
                sha.append(hashlib.sha256(flat).hexdigest())
                if len(words) < width:
                    seeds.append(np.empty(0, np.int64))
                    often.append(np.empty(0, bool))
                    continue
                runs, low = smallest_runs(hashes(words), width)
                s = np.unique(low)
                runs.sort()
                many = np.searchsorted(runs, s, "right") - np.searchsorted(runs, s, "left") > 1
                seeds.append(s.view(np.int64))
                often.append(many)
            if not n:
                continue
            c = np.array(c)
            offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in seeds])].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(np.ascontiguousarray(c[:, 0])),
                 pa.array(np.ascontiguousarray(c[:, 1])), pa.array(sha),
                 pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(seeds))),
                 pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(often)))],
                names=["doc_id", "row_key", "n_words", "c1", "c2", "sha", "seeds", "often"])
    return run


def _recurring(batches):
    """Rows (seed, c1, often) in order to the rows whose seed is another class's too, is often in its own text, or may go
    on in the next partition."""
    held = np.empty((0, 3), np.int64)
    start = True

    def judge(rows, last):
        """Rows of whole groups; the first group of a partition and its last may be parts of groups."""
        seed, cls, often = rows.T
        new = np.r_[True, seed[1:] != seed[:-1]]
        group = np.cumsum(new) - 1
        other = np.r_[False, (cls[1:] != cls[:-1]) & ~new[1:]]
        hit = np.zeros(group[-1] + 1, bool)
        np.logical_or.at(hit, group, other | (often > 0))
        if start:
            hit[0] = True
        if last:
            hit[-1] = True
        keep = hit[group] & np.r_[True, ~new[1:] & (cls[1:] != cls[:-1]) | new[1:]]
        return pa.RecordBatch.from_arrays([pa.array(seed[keep]), pa.array(cls[keep])], names=["seed", "c1"])

    for batch in batches:
        rows = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)])
        if not len(rows):
            continue
        rows = np.concatenate([held, rows]) if len(held) else rows
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0], "left"))
        if cut:
            yield judge(rows[:cut], False)
            start = False
        held = rows[cut:]
        if len(held) > 4:  # of a group that goes on, each class once; many classes are written at once, but for two
            at = np.flatnonzero(np.r_[True, held[1:, 1] != held[:-1, 1]])
            held = np.column_stack([held[at, 0], held[at, 1], np.maximum.reduceat(held[:, 2], at)])
            if len(held) > 4:
                yield pa.RecordBatch.from_arrays([pa.array(held[:-2, 0]), pa.array(held[:-2, 1])], names=["seed", "c1"])
                held = held[-2:]
    if len(held):
        yield judge(held, True)


def _segments(width):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            doc, rk, seeds, text = (batch.column(i).to_pylist() for i in range(4))
            rows = []
            for d, r, wanted, t in zip(doc, rk, seeds, text):
                words = t.encode().split()
                low = smallest_runs(hashes(words), width)[1].view(np.int64)
                salts = {w["seed"]: w["salts"] for w in wanted}
                first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
                last = np.r_[first[1:], len(low)] - 1
                for i, j in zip(first.tolist(), last.tolist()):
                    s = int(low[i])
                    m = salts.get(s)
                    if m:
                        salt = xxhash.xxh3_64_intdigest(f"{d} {r}") % m if m > 1 else 0
                        rows.append((s, salt, m > 1, d, r, i, b" ".join(words[i:j + width])))
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int64()),
                 pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.binary())],
                names=["seed", "salt", "salted", "doc_id", "row_key", "at", "words"])
    return run


class Shard:
    """Some whole groups of segments in order: propose passages, compile, locate."""

    def __init__(self, width):
        self.width, self.hashes = width, WordHashes()

    def covered(self, rows):
        """rows: (seed, salt, salted, doc, row_key, at, words). Gives cover rows (doc, row_key, lo, hi) and, for salted
        groups, first rows (seed, hash, doc, row_key, at)."""
        w = self.width
        words, counts = [], []
        for r in rows:
            own = r[6].split(b" ")
            words += own
            counts.append(len(own))
        lengths = np.array(counts)
        begin = np.cumsum(lengths) - lengths  # first word of each segment
        counts = lengths - w + 1
        base = np.cumsum(counts) - counts  # first window of each segment
        seg = np.repeat(np.arange(len(rows)), counts)
        pos = np.arange(len(seg)) - base[seg]
        h = gram_hashes(self.hashes(words), w)[begin[seg] + pos]
        group = scramble(np.array([r[0] for r in rows], np.int64).view(np.uint64) + np.array([r[1] for r in rows], np.uint64))
        key = h ^ group[seg]
        order = np.argsort(key, kind="stable")
        new = np.r_[True, key[order][1:] != key[order][:-1]]
        heads = np.flatnonzero(new)
        kind = np.empty(len(key), np.int64)  # windows of one hash in one group
        kind[order] = np.cumsum(new) - 1
        ends = np.r_[pos[1:] == 0, True]  # last windows of their segments

        def runs(marks):
            """First and last windows of the runs of marked windows inside segments."""
            starts = np.flatnonzero(marks & (~np.r_[False, marks[:-1]] | (pos == 0)))
            return starts, np.flatnonzero(marks & (~np.r_[marks[1:], False] | ends))

        def always(neighbour):
            """For each kind the kind that is its neighbour wherever it occurs, or -1."""
            low, high = (f.reduceat(neighbour[order], heads) for f in (np.minimum, np.maximum))
            return np.where(low == high, low, -1)

        after = always(np.where(ends, -1, np.r_[kind[1:], -1]))
        before = always(np.where(pos == 0, -1, np.r_[-1, kind[:-1]]))
        goes_on = after >= 0
        goes_on[goes_on] = before[after[goes_on]] >= 0
        opens = np.diff(np.r_[heads, len(key)]) > 1
        opens[after[goes_on]] = False

        # passages: one pattern for each, in the words of its first occurrence
        a, sizes = ahocorasick.Automaton(), []
        stops = np.flatnonzero(~goes_on[kind])
        lows = order[heads[opens]]
        for lo, hi in zip(lows.tolist(), stops[np.searchsorted(stops, lows)].tolist()):
            o, n = int(begin[seg[lo]] + pos[lo]), hi - lo + w
            text = " %s " % b" ".join(words[o:o + n]).decode("latin-1")
            if text not in a:
                a.add_word(text, len(sizes))
                sizes.append(n)
        found = np.zeros(len(key) + 1, np.int64)
        hits = []
        if sizes:
            a.make_automaton()
            hits = [(i, end, p) for i, r in enumerate(rows) for end, p in a.iter(" %s " % r[6].decode("latin-1"))]
        if hits:
            i, end, p = np.array(hits).T
            spaces = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # where the space behind each word is
            last = np.searchsorted(spaces, end + np.r_[0, spaces][begin[i]]) - begin[i]
            number = np.cumsum([0] + [x[:2] != y[:2] for x, y in zip(rows, rows[1:])])  # of each segment's group
            later = np.ones(len(i), bool)
            later[np.unique(number[i] * len(sizes) + p, return_index=True)[1]] = False  # the first one in a group stays
            i, last, n = i[later], last[later], np.array(sizes)[p[later]]
            np.add.at(found, base[i] + last - n + 1, 1)
            np.add.at(found, base[i] + last - w + 2, -1)
        gone = np.cumsum(found[:-1]) > 0
        cover, firsts = [], []
        for lo, hi in zip(*(x.tolist() for x in runs(gone))):
            r, at = rows[seg[lo]], int(pos[lo])
            cover.append((r[3], r[4], r[5] + at, r[5] + at + hi - lo + w))
        salted = np.array([r[2] for r in rows])[seg] & ~gone
        for x in np.flatnonzero(salted).tolist():
            r = rows[seg[x]]
            firsts.append((r[0], int(h.view(np.int64)[x]), r[3], r[4], r[5] + int(pos[x])))
        return cover, firsts


COVER = "kind int, doc_id long, row_key long, lo long, hi long, seed long, hash long"


def _locate(width):
    def out(cover, firsts):
        rows = [(0, d, r, lo, hi, None, None) for d, r, lo, hi in cover] + [(1, d, r, at, at + width, s, h) for s, h, d, r, at in firsts]
        cols = list(zip(*rows)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.int64()) for c in cols[1:]],
                                          names=["kind", "doc_id", "row_key", "lo", "hi", "seed", "hash"])

    def run(batches):
        shard, rows = Shard(width), []
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if not rows or rows[-1][:6] != r[:6]:  # equal rows of the input count once
                    rows.append(r)
            if len(rows) < SHARD:
                continue
            cut = len(rows) - 1
            while cut and rows[cut - 1][:2] == rows[-1][:2]:
                cut -= 1
            if cut:
                yield out(*shard.covered(rows[:cut]))
                rows = rows[cut:]
        if rows:
            yield out(*shard.covered(rows))
    return run


def _remove(batches):
    for batch in batches:
        doc, rk, cover, text = (batch.column(i).to_pylist() for i in range(4))
        gone, kept = [], []
        for ranges, t in zip(cover, text):
            words = t.encode().split()
            mark = np.zeros(len(words) + 1, np.int64)
            for x in ranges or []:
                mark[x["lo"]] += 1
                mark[x["hi"]] -= 1
            covered = np.cumsum(mark[:-1]) > 0
            gone.append(int(covered.sum()))
            kept.append(b" ".join(w for w, c in zip(words, covered.tolist()) if not c).decode())
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(rk, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                         names=["doc_id", "row_key", "n_removed", "kept"])


def _same(a, b):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.row_key") == F.col(f"{b}.row_key"))


def repeated_phrases(docs: DataFrame, width: int = 20, group: int = GROUP):
    """Two tables. The first has a row for each row of ``docs``: doc_id, row_key, n_words, sha (of all its words joined by
    one space) and copy (its words are all in an earlier text too, so it loses every word). The second has a row for each
    other text that loses words: doc_id, row_key, n_removed and kept (the words that stay, joined by one space).

    A word goes when a window of ``width`` words that covers it also starts earlier: in a smaller doc_id, or earlier in
    its own text. Rows that share a doc_id are ordered by a hash of their text; equal rows are one document and get equal
    results (the second table has one for each). A null doc_id comes before all others. Null texts and texts of fewer words than a window lose nothing. Extra
    columns are ignored; an empty table gives empty tables.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), whole().alias("text"))
    info = materialise(d.mapInArrow(_digests(width), "doc_id long, row_key long, n_words long, c1 long, c2 long, sha string, "
                                                     "seeds array<long>, often array<boolean>"))
    long = info.where(F.col("n_words") >= width)
    classes = long.groupBy("c1", "c2").agg(F.min(F.struct(*KEYS)).alias("first"))
    classes = materialise(classes.select("c1", "c2", "first.*"))

    rows = long.select("c1", F.explode(F.arrays_zip("seeds", "often")).alias("s")).select(F.col("s.seeds").alias("seed"), "c1", F.col("s.often").alias("often"))
    rows = rows.repartitionByRange("seed", "c1").sortWithinPartitions("seed", "c1")
    wanted = materialise(rows.mapInArrow(_recurring, "seed long, c1 long"))
    hot = wanted.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > group).select("seed", F.ceil(F.col("n") / group).cast("int").alias("salts"))
    wanted = wanted.join(hot, "seed", "left").groupBy("c1").agg(F.collect_set(F.struct("seed", F.coalesce("salts", F.lit(1)).alias("salts"))).alias("seeds"))
    wanted = wanted.join(classes, "c1").select(*KEYS, "seeds")
    texts = materialise(d.alias("a").join(wanted.alias("b"), _same("a", "b")).select("a.doc_id", "a.row_key", "b.seeds", "a.text"))

    segments = texts.mapInArrow(_segments(width), "seed long, salt long, salted boolean, doc_id long, row_key long, at long, words binary")
    segments = segments.repartition("seed", "salt").sortWithinPartitions("seed", "salt", *KEYS, "at")
    located = materialise(segments.mapInArrow(_locate(width), COVER))
    firsts = located.where("kind = 1").select("seed", "hash", *KEYS, "lo", "hi")
    lowest = firsts.groupBy("seed", "hash").agg(F.min(F.struct(*KEYS, "lo")).alias("low"))
    later = firsts.join(lowest, ["seed", "hash"]).where(~F.struct(*KEYS, "lo").eqNullSafe(F.col("low")))
    cover = located.where("kind = 0").select(*KEYS, "lo", "hi").unionByName(later.select(*KEYS, "lo", "hi"))
    cover = cover.groupBy(*KEYS).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    bare = texts.select(*KEYS, "text")
    hit = bare.alias("a").join(cover.alias("b"), _same("a", "b")).select("a.doc_id", "a.row_key", "b.ranges", "a.text")
    removed = hit.mapInArrow(_remove, "doc_id long, row_key long, n_removed long, kept string")

    mark = info.select(*KEYS, "n_words", "c1", "c2", "sha").alias("i").join(
        classes.select(F.col("c1").alias("_1"), F.col("c2").alias("_2"), F.col("doc_id").alias("_d"), F.col("row_key").alias("_r")),
        (F.col("c1") == F.col("_1")) & (F.col("c2") == F.col("_2")) & (F.col("n_words") >= width), "left")
    first = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row_key") == F.col("_r"))
    mark = mark.select(*KEYS, "n_words", "sha", (F.col("_r").isNotNull() & ~first).alias("copy"))
    return mark, removed
