"""S1 by frontier: directories are rows, expanded level by level, and a pruned directory is never descended into.

``walk`` knows nothing of where entries come from: ``expand`` turns a table of directories into their entries. Two are
given, ``directory_lister`` (tasks list directories of a shared file system) and ``table_lister`` (an inventory of
entries that lies in a table). Each level is written before the next starts, so a lost executor lists one level again.
"""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.session import cut_lineage
from assetlake.sources.corpus import DEFAULT_MARKER

ENTRY = "dir string, rel_dir string, name string, is_dir boolean, length long, modificationTime timestamp"


def walk(roots: DataFrame, expand: Callable[[DataFrame], DataFrame], recurse: bool = True, exclude: str = None,
         suffix: str = "[zip]", marker: str = DEFAULT_MARKER, ends: str = ".png") -> DataFrame:
    """The files below ``roots`` (a table with ``dir``) whose names end in ``ends``: path, rel_dir, length, modificationTime.

    Not descended into: directories named ``*suffix`` and the directory ``exclude`` (both in any case), and directories
    that hold the file ``marker``; those have their own entries seen once and nothing below. The roots themselves are
    exempt from all three. Unreadable and missing directories are empty ones; without roots the result is empty."""
    frontier = roots.select("dir", F.lit("").alias("rel_dir"))
    excluded = None if exclude is None else exclude.rstrip("/").lower()
    found, root = None, True
    while True:
        level = cut_lineage(expand(frontier))
        if not root:
            marked = level.where((F.col("name") == marker) & ~F.col("is_dir")).select("dir").distinct()
            level = level.join(marked, "dir", "left_anti")
        path = F.concat(F.regexp_replace("dir", r"/+\z", ""), F.lit("/"), "name")
        files = level.where(~F.col("is_dir") & F.col("name").endswith(ends)).select(path.alias("path"), "rel_dir", "length", "modificationTime")
        found = files if found is None else found.unionByName(files)
        if not recurse:
            return found
        below = level.where(F.col("is_dir") & ~F.lower("name").endswith(suffix.lower()))
        if excluded is not None:
            below = below.where(F.lower(path) != excluded)
        rel = F.when(F.col("rel_dir") == "", F.col("name")).otherwise(F.concat("rel_dir", F.lit("/"), "name"))
        frontier, root = below.select(path.alias("dir"), rel.alias("rel_dir")), False
        if frontier.isEmpty():
            return found


def table_lister(entries: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Entries from a table (dir, name, is_dir, length, modificationTime), met on the directory."""
    e = entries.select("dir", "name", "is_dir", "length", "modificationTime")
    return lambda frontier: frontier.join(e, "dir").select("dir", "rel_dir", "name", "is_dir", "length", "modificationTime")


def directory_lister(parallelism: int = None) -> Callable[[DataFrame], DataFrame]:
    """Lists directories in tasks, hidden names included. Paths are URIs of a file system that pyarrow knows and every
    executor reaches; plain paths are local ones, for tests. The directories of a level are dealt over the tasks by hash."""
    def look(batches):
        import pyarrow as pa
        from pyarrow import fs
        for batch in batches:
            for uri, rel in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if uri.startswith("file:") or ":" not in uri.split("/", 1)[0]:
                    store, at = fs.LocalFileSystem(), "/" + uri.removeprefix("file:").strip("/")
                else:
                    store, at = fs.FileSystem.from_uri(uri)
                try:
                    got = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
                except OSError:  # no permission, or gone since
                    got = []
                for i in range(0, len(got), 10_000):
                    part = got[i:i + 10_000]
                    changed = [None if x.mtime_ns is None else x.mtime_ns // 1000 for x in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uri] * len(part)), pa.array([rel] * len(part)), pa.array([x.base_name for x in part]),
                         pa.array([x.type == fs.FileType.Directory for x in part]), pa.array([x.size for x in part], pa.int64()),
                         pa.array(changed, pa.timestamp("us", "UTC"))],
                        names=["dir", "rel_dir", "name", "is_dir", "length", "modificationTime"])

    def expand(frontier: DataFrame) -> DataFrame:
        return frontier.repartition(*([parallelism] if parallelism else []), "dir").mapInArrow(look, ENTRY)
    return expand


def walk_corpus(spark: SparkSession, root: str, recurse: bool = True, exclude: str = None, suffix: str = "[zip]",
                marker: str = DEFAULT_MARKER) -> DataFrame:
    """``walk`` over one directory tree."""
    root = root.rstrip("/") or "/"
    return walk(spark.range(1).select(F.lit(root).alias("dir")), directory_lister(), recurse, exclude, suffix, marker)
