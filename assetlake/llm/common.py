"""Helpers that several training-data operators share."""
import numpy as np
import xxhash
from pyspark.sql import functions as F

from assetlake.session import cut_lineage as materialise  # noqa: F401  written to the shared folder, read back

WS = " \t\n\x0b\x0c\r"
MIX = np.uint64(0x9E3779B97F4A7C15)


def discard(table):
    """Deletes the files of a table that ``materialise`` has written and nothing reads any more."""
    spark, files = table.sparkSession, table.inputFiles()
    if not files:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    if path.getName().startswith("assetlake-"):
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def whole(col="text"):
    """The text, a null one as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def row_key(col="text"):
    """Tells apart rows that share a doc_id; equal rows have equal keys and get equal results."""
    return F.xxhash64(F.lit(17), F.col(col) if isinstance(col, str) else col)


class WordHashes:
    """64-bit hashes of words, with a table of bounded size for those seen before."""

    def __init__(self, limit=400_000):
        self.known, self.limit = {}, limit

    def __call__(self, words) -> np.ndarray:
        """words: a list of bytes."""
        known, digest = self.known, xxhash.xxh3_64_intdigest
        for w in set(words).difference(known):
            known[w] = digest(w)
        out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > self.limit:
            known.clear()
        return out


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes (empty when there are fewer words), put together from runs of 1, 2, 4, ... words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size, have, out = words, 1, 0, None
    while True:
        if k & size:
            part = power[have:have + n]
            out = part if out is None else scramble(out[:n] * MIX + part)
            have += size
        size *= 2
        if size > k:
            return out[:n].copy()
        power = scramble(power[:-(size // 2)] * MIX + power[size // 2:])
