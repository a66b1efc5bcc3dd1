"""LM scoring: stupid-backoff scores computed relationally.

1. Documents are read once into blocks of some million words, written as word codes with the block's vocabulary of hashes.
2. Each block explodes its n-grams, one order at a time, and counts them; its different n-grams go to the count tables, which are
   partitioned by ranges of the n-gram's hash. So a frequent n-gram is one row a block there, however often it occurs.
3. A partition sums the counts of the blocks and answers each block in the order it asked, with totals alone.
4. A block joins its exploded n-grams to the totals, takes off what each document holds itself (else every n-gram would
   be known), and sums by document.
Hashes travel sorted, as differences, with a compressor over their byte planes. The number of partitions follows the number of
words, so neither a block nor a partition grows with the corpus.
"""
import os
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import WordHashes, gram_hashes, row_key, scramble, whole
from assetlake.session import shared_dir

BLOCK = "block long, doc_ids array<long>, row_keys array<long>, lengths array<int>, n_words long, vocabulary binary, codes binary"
SCORE = "doc_id long, row_key long, n_words long, score double"


def pack(x: np.ndarray) -> bytes:
    """The bytes of whole numbers, plane by plane, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_hashes(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_hashes(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def encode(words: np.ndarray) -> tuple[bytes, bytes]:
    """Word hashes as (vocabulary, codes): frequent words have small codes, words of like frequency lie sorted."""
    v, code, n = np.unique(words, return_inverse=True, return_counts=True)
    order = np.lexsort((v, -np.frexp(n)[1]))
    rank = np.empty(len(v), np.uint32)
    rank[order] = np.arange(len(v), dtype=np.uint32)
    return pack_hashes(v[order]), pack(rank[code])


def _blocks(block_words):
    def run(batches):
        hashes, first, made = WordHashes(), TaskContext.get().partitionId() << 32, 0
        ids, keys, words, held = [], [], [], 0

        def block():
            lengths = [len(w) for w in words]
            vocabulary, codes = encode(np.concatenate(words))
            return pa.RecordBatch.from_pylist([{
                "block": first + made, "doc_ids": ids, "row_keys": keys, "lengths": lengths, "n_words": sum(lengths), "vocabulary": vocabulary,
                "codes": codes}], pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("row_keys", pa.list_(pa.int64())),
                                             ("lengths", pa.list_(pa.int32())), ("n_words", pa.int64()), ("vocabulary", pa.binary()), ("codes", pa.binary())]))

        for batch in batches:
            for doc, key, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                ids.append(doc)
                keys.append(key)
                words.append(hashes(text.encode().split()))  # bytes: only ASCII white space splits
                held += len(words[-1]) + 1
                if held >= block_words:
                    yield block()
                    ids, keys, words, held, made = [], [], [], 0, made + 1
        if ids:
            yield block()
    return run


def _read(row):
    """Word hashes of a block, the document of each word and its place there, lengths of the documents."""
    lengths = np.array(row["lengths"], np.int64)
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    place = (np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
    return unpack_hashes(row["vocabulary"])[unpack(row["codes"], np.uint32)], doc, place, lengths


def _grams(words, place, k):
    """Hashes of the n-grams of k words that lie in one document, and the places of their last words."""
    at = np.flatnonzero(place >= k - 1)
    return at, scramble(gram_hashes(words, k)[at - (k - 1)] + np.uint64(k)) if len(at) else np.empty(0, np.uint64)


def _ask(order, partitions):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, _, place, _ = _read(row)
                for k in range(1, order + 1):
                    asked, n = np.unique(_grams(words, place, k)[1], return_counts=True)
                    part = ((asked >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)).astype(np.int64)
                    starts = np.flatnonzero(np.diff(part, prepend=-1))
                    for a, z in zip(starts, np.r_[starts[1:], len(part)]):
                        yield pa.RecordBatch.from_pydict({
                            "k": pa.array([k], pa.int64()), "part": pa.array([part[a]], pa.int64()), "block": pa.array([row["block"]], pa.int64()),
                            "asked": pa.array([pack_hashes(asked[a:z])], pa.binary()), "n": pa.array([pack(n[a:z].astype(np.uint32))], pa.binary())})
    return run


def _total(table: pa.Table) -> pa.Table:
    asked = [unpack_hashes(b) for b in table["asked"].to_pylist()]
    n = np.concatenate([unpack(b, np.uint32) for b in table["n"].to_pylist()]).astype(np.int64)
    different, which = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.zeros(len(different), np.int64)
    np.add.at(total, which, n)
    cuts = np.cumsum([len(a) for a in asked])[:-1]
    return pa.table({"block": table["block"], "k": table["k"], "part": table["part"],
                     "total": pa.array([pack(x) for x in np.split(total[which], cuts)], pa.binary())})


def _score(order, backoff, size):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        row = blocks.to_pylist()[0]
        words, doc, place, lengths = _read(row)
        parts = sorted(answers.to_pylist(), key=lambda r: (r["k"], r["part"]))
        score = context = None
        for k in range(1, order + 1):
            at, g = _grams(words, place, k)
            asked, which = np.unique(g, return_inverse=True)
            pair = doc[at] * np.int64(max(len(asked), 1)) + which
            total = np.concatenate([np.empty(0, np.int64), *(unpack(r["total"], np.int64) for r in parts if r["k"] == k)])
            others = np.zeros(len(doc), np.int64)
            others[at] = total[which]
            del g, asked, which, total
            _, which, own = np.unique(pair, return_inverse=True, return_counts=True)
            others[at] -= own[which]
            if k == 1:
                score = np.log(np.maximum(others, 1) * backoff ** (order - 1) / size)
            else:
                seen = np.flatnonzero(others)
                score[seen] = np.log(backoff ** (order - k) * others[seen] / context[seen - 1])
            context = others
        sums = np.bincount(doc, score, len(lengths)) if len(doc) else np.zeros(len(lengths))
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "row_key": pa.array(row["row_keys"], pa.int64()),
                         "n_words": pa.array(lengths), "score": pa.array(sums, pa.float64())})
    return run


def _write_blocks(blocks: DataFrame) -> DataFrame:
    """The blocks in the shared folder, bucketed by block: answers come to them, they do not move again."""
    spark = blocks.sparkSession
    name = "assetlake_blocks_" + uuid.uuid4().hex
    (blocks.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
     .option("path", os.path.join(shared_dir(spark), name)).saveAsTable(name))
    return spark.table(name)


def score_documents(docs: DataFrame, order: int = 3, backoff: float = 0.4, block_words: int = 3_000_000, part_grams: int = 2_000_000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, row_key, n_words and score, the sum of the words' log scores (0 without
    words: null, empty and blank texts).

    Every row is a document of its own, a repeated one too, which then finds all its n-grams in its copies; a null doc_id
    is one like others. Extra columns are ignored; an empty table gives an empty result. A word never seen elsewhere gets
    what one occurrence among all words would, after all backoffs. ``block_words`` and ``part_grams`` bound what a task
    holds (a text longer than a block is a block by itself); results do not depend on them."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), whole().alias("text"))
    blocks = _write_blocks(d.mapInArrow(_blocks(block_words), BLOCK))
    size = blocks.agg(F.sum("n_words")).first()[0] or 0
    partitions = max(1, -(-size // part_grams))  # of each order
    asks = blocks.mapInArrow(_ask(order, partitions), "k long, part long, block long, asked binary, n binary")
    answers = asks.groupBy("k", "part").applyInArrow(_total, "block long, k long, part long, total binary")
    found = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, backoff, max(size, 1)), SCORE)
    return found.withColumn("score", F.round("score", 6))
