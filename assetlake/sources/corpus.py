"""Listing a corpus and mapping output paths."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.fixed import HEAD_BYTES
from assetlake.functions.text import file_name

DEFAULT_MARKER = ".asset-output"


def list_corpus(spark: SparkSession, root: str, recurse: bool = True, exclude: str = None,
                suffix: str = "[zip]", marker: str = DEFAULT_MARKER, content: bool = False) -> DataFrame:
    """The *.png files under ``root`` with their directory relative to it.

    Listing is Spark's own; ``content`` is only read when asked for. Pass the marker file name your
    producing tool leaves in its output directories."""
    cols = ["path", "modificationTime", "length"] + (["content"] if content else [])
    found = (spark.read.format("binaryFile").option("pathGlobFilter", "*.png")
             .option("recursiveFileLookup", str(recurse).lower()).load(root).select(*cols))
    return prune_listing(found, marked_dirs(found, root, marker), root, exclude, suffix)


def marked_dirs(found: DataFrame, root: str, marker: str) -> DataFrame:
    """Paths of the marker files in directories that lead to a listed file.

    Spark's listing leaves out hidden names, and a marker usually is one, so tasks probe each distinct
    directory once (any file system pyarrow knows)."""
    probe = found.select("path").withColumn("rel_dir", relative_dir(F.col("path"), root))
    base = F.substring("path", F.lit(1), F.length("path") - F.length(file_name(F.col("path"))) - F.length("rel_dir") - 1)
    dirs = probe.select(base.alias("base"), F.explode(ancestors(F.col("rel_dir"))).alias("dir")).distinct()

    def look(batches):
        from pyarrow import fs
        for pdf in batches:
            for uri, group in pdf.groupby("base"):
                if uri.startswith("file:"):
                    store, top = fs.LocalFileSystem(), "/" + uri[5:].strip("/")
                else:
                    store, top = fs.FileSystem.from_uri(uri)
                info = store.get_file_info([f"{top.rstrip('/')}/{d}/{marker}" for d in group["dir"]])
                seen = [i.type != fs.FileType.NotFound for i in info]
                path = uri.rstrip("/") + "/" + group["dir"] + "/" + marker
                yield path[seen].to_frame("path")
    return dirs.mapInPandas(look, "path string")


def ancestors(rel_dir: Column) -> Column:
    """All directories on the way: 'a/b' -> ['a', 'a/b']."""
    parts = F.filter(F.split(rel_dir, "/"), lambda d: d != "")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(F.size(parts) > 0, steps)


def relative_dir(path: Column, root: str) -> Column:
    """Directory of ``path`` below ``root`` ('' for files directly in it)."""
    tail = F.regexp_replace(path, r"^[a-z]+:/+", "/")
    base = F.lit("/" + root.split(":", 1)[-1].strip("/"))
    directory = F.regexp_replace(tail, r"/[^/]*\z", "")
    return F.regexp_replace(F.substring(directory, F.length(base) + 1, F.length(directory)), "^/", "")


def prune_listing(found: DataFrame, marks: DataFrame, root: str, exclude: str = None,
                  suffix: str = "[zip]") -> DataFrame:
    """The pruning half of S1 on any table with a ``path`` column: drop the excluded subtree, every
    directory ending in ``suffix`` (any case) below the root and every subtree with a marker file.

    Every ancestor of a file is checked by an anti join on (ancestor directory), which is an equi-join."""
    df = found.withColumn("rel_dir", relative_dir(F.col("path"), root))
    parts = F.filter(F.split("rel_dir", "/"), lambda d: d != "")
    bad_name = F.exists(parts, lambda d: F.lower(d).endswith(suffix.lower()))
    df = df.where(~bad_name)
    if exclude:
        rel = exclude.split(":", 1)[-1].strip("/")
        base = root.split(":", 1)[-1].strip("/")
        if rel.lower().startswith(base.lower()):
            rel = rel[len(base):].strip("/").lower()
            low = F.lower("rel_dir")
            df = df.where(~((low == rel) | low.startswith(rel + "/")))
    marked = marks.select(relative_dir(F.col("path"), root).alias("_anc")).where(F.col("_anc") != "").distinct()
    hit = (df.select("path", F.explode(ancestors(F.col("rel_dir"))).alias("_anc")).join(marked, "_anc", "left_semi")
           .select("path").distinct())
    return df.join(hit, "path", "left_anti")


def head(files: DataFrame, n: int = HEAD_BYTES) -> DataFrame:
    """The first n bytes; the full content column goes, so nothing downstream carries it."""
    return files.withColumn("head", F.substring("content", 1, n)).drop("content")


def default_output(path: str, is_dir: bool) -> str:
    """K1: X -> X/X[zip] for a directory, parent/compressed for a file."""
    path = path.rstrip("/")
    if is_dir:
        return f"{path}/{path.rsplit('/', 1)[-1] or 'cards'}[zip]"
    return f"{path.rsplit('/', 1)[0] if '/' in path else '.'}/compressed"


def output_paths(files: DataFrame, out_root: str, suffix: str = "") -> DataFrame:
    """K1: mirror the relative directory below out_root; stem + suffix + .png."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)\z", 1), r"\.[^.]*\z", "")
    directory = F.when(F.col("rel_dir") != "", F.concat_ws("/", F.lit(out_root), "rel_dir")).otherwise(F.lit(out_root))
    return files.withColumn("out_dir", directory).withColumn(
        "out_path", F.concat("out_dir", F.lit("/"), stem, F.lit(suffix + ".png")))
