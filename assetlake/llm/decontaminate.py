"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Texts and items are normalised alike (A-Z lowered, every other ASCII character but letters and digits becomes a gap,
gaps become one space). The automaton holds each window of ten consecutive item words between spaces; a document is
scanned once, and hits are mapped back from the normalised text to word numbers and to offsets in the original.
"""
import re

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import materialise, row_key, whole

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or c >= 97 and c <= 122 or c >= 128 else 32 for c in range(256))
#: Characters of item text for one automaton: each costs some ten nodes, so an automaton stays below about 100 MB.
SHARD_CHARS = 200_000
RESULT = "doc_id long, row_key long, n_words long, hits array<long>, items array<long>, spans array<struct<start:long,end:long>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def windows(words: list[bytes], width: int) -> set[bytes]:
    if not words:
        return set()
    return {b" %b " % b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def automaton(items, width: int):
    """items: (item_id, text) pairs. None when no item has a word."""
    found: dict[bytes, list[int]] = {}
    for item, text in items:
        for w in windows(words_of((text or "").encode()), width):
            found.setdefault(w, []).append(item)
    a = ahocorasick.Automaton()
    for w, ids in found.items():
        a.add_word(w.decode("latin-1"), (w.count(b" ") - 1, len(w), tuple(ids)))
    if not found:
        return None
    a.make_automaton()
    return a


def scan(text: str, a):
    """Number of words, numbers of the words hit, items found, and the hit stretches as offsets in the text."""
    raw = text.encode()
    words = words_of(raw)
    if a is None or not words:
        return len(words), [], [], []
    flat = " %s " % b" ".join(words).decode("latin-1")
    hit, items, ends = None, set(), None
    for end, (n, size, ids) in a.iter(flat):
        if hit is None:
            hit = np.zeros(len(words) + 1, np.int32)
            ends = np.cumsum([len(w) + 1 for w in words])  # where the space behind each word is
        last = int(np.searchsorted(ends, end))
        hit[last - n + 1] += 1
        hit[last + 1] -= 1
        items.update(ids)
    if hit is None:
        return len(words), [], [], []
    numbers = np.flatnonzero(np.cumsum(hit[:-1]))
    at = [m.span() for m in WORD.finditer(raw)]
    breaks = np.flatnonzero(np.diff(numbers) > 1)
    first, last = numbers[np.r_[0, breaks + 1]], numbers[np.r_[breaks, len(numbers) - 1]]
    chars = lambda b: len(raw[:b].decode())
    return len(words), numbers.tolist(), sorted(items, key=lambda x: (x is not None, x)), [
        {"start": chars(at[f][0]), "end": chars(at[t][1])} for f, t in zip(first, last)]


def _scanner(items, width, schema):
    def run(batches):
        a = automaton(items, width)
        for batch in batches:
            cols = [batch.column(0), batch.column(1)]
            found = [scan(t, a) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                cols + [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64())),
                        pa.array([f[2] for f in found], pa.list_(pa.int64())),
                        pa.array([f[3] for f in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "row_key", "n_words", "hits", "items", "spans"])
    return run


def _deal(benchmark, shard_chars):
    """Items (item_id, text), and over how many automata they must go."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), whole().alias("text"))
    chars = b.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    return b, max(1, -(-chars // shard_chars))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no window of an item."""
    b, n = _deal(benchmark, shard_chars)
    if n > 1:
        found = scan_documents(docs, benchmark, width, shard_chars).where(F.size("hits") > 0)
        found = found.select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_row"))
        return docs.join(found, docs["doc_id"].eqNullSafe(found["_doc"]) & row_key(docs["text"]).eqNullSafe(found["_row"]), "left_anti")
    items, ready = [tuple(r) for r in b.collect()], []

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        if not ready:
            ready.append(automaton(items, width))
        return pd.Series([not scan(t, ready[0])[1] for t in texts], dtype=bool)

    return docs.where(clean(whole()))


def scan_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, row_key (a hash of the text), n_words, hits (numbers of the words inside
    a window), items (ids of the items found, in order) and spans (stretches of hit words as offsets in the text).

    Items with fewer words than ``width`` are one window, items without words none. The items' text is measured first:
    up to ``shard_chars`` characters go into one automaton and one scan; more are dealt to as many automata as needed,
    each with its own scan, and what they find is merged by document. Null texts have no words; null and repeated doc_id
    are kept as they are; a null item_id is an item like others. Extra columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), whole().alias("text"))
    b, n = _deal(benchmark, shard_chars)
    if n == 1:
        return d.mapInArrow(_scanner([tuple(r) for r in b.collect()], width, RESULT), RESULT)
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    b = materialise(b.withColumn("shard", shard))
    parts = None
    for k in range(n):
        items = [tuple(r) for r in b.where(F.col("shard") == k).select("item_id", "text").collect()]
        part = d.distinct().mapInArrow(_scanner(items, width, RESULT), RESULT)
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("doc_id", "row_key").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    keys = docs.select(F.col("doc_id").cast("long").alias("_d"), row_key().alias("_r"))
    return keys.join(merged, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_r") == F.col("row_key"))).drop("_d", "_r")
