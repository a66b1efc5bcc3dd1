"""Process only what is new, and keep running class totals."""
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTITY = ["path", "modificationTime", "length"]


def new_files(files: DataFrame, manifest: DataFrame, identity=IDENTITY) -> DataFrame:
    """I1 (batch): files whose (path, mtime, length) is not in the manifest."""
    return files.join(manifest.select(*identity), list(identity), "left_anti")


def manifest_rows(files: DataFrame, containers: DataFrame, identity=IDENTITY) -> DataFrame:
    """What to append to the manifest after a scan. Files whose scan failed (rc 2 or 4) stay out, so
    the next run tries them again."""
    good = containers.where(F.col("rc").isin(0, 3)).select(F.col("container_id").alias("path"))
    return files.join(good, "path", "left_semi").select(*identity)


def stream_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """I1 (stream): arriving *.png files; the checkpoint of the query is the manifest."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    s = (spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.png")
         .option("recursiveFileLookup", "true").load(root))
    return s if content else s.drop("content")


# ---- I1 as a stream ------------------------------------------------------------------------------------

FAILED = (2, 4)
SEEN = "micros long, length long"


def _newest_if_changed(key, batches, state):
    """One path: its newest row of the batch if that differs from the identity last seen, or if a failed scan is due again.

    A row that is due again has -1 - length for its length. A path listed once, the usual case, goes on as the frame it
    came in: making frames is most of what a path costs."""
    seen, listed, due, n = state.get if state.exists else None, None, None, 0
    for rows in batches:
        for micros, length in zip(rows["micros"].tolist(), rows["length"].tolist()):
            n += 1
            if length >= 0:
                listed = max(listed or (micros, length), (micros, length))
            else:
                due = max(due or (micros, -1 - length), (micros, -1 - length))
    newest = listed or seen or due
    if newest != seen:
        state.update(newest)
    elif due is None:
        return
    yield rows if n == 1 and listed else pd.DataFrame({"path": [key[0]], "micros": [newest[0]], "length": [newest[1]]})


def changed_files(listing: DataFrame) -> DataFrame:
    """I1 on a stream of listings (path, micros, length, retry): paths that are new, changed or due again, once a batch.

    State is keyed by path and holds the identity (mtime, length) last passed on, so repeated listings of the whole corpus
    cost one shuffled row a file and no join with a growing manifest."""
    length = F.when(F.col("retry"), F.lit(-1) - F.col("length")).otherwise(F.col("length"))
    return listing.select("path", "micros", length.alias("length")).groupBy("path").applyInPandasWithState(_newest_if_changed, f"path string, {SEEN}", SEEN, "append", "NoTimeout")


def scan_arrivals(listing: DataFrame, scan: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, manifest: DataFrame = None):
    """I1 (stream): scan what is new in ``listing`` (a stream of path, modificationTime, length) and leave the outcomes below
    ``root``; runs until all that has arrived is done.

    scan: a batch (path, modificationTime, length) to the same rows with rc. A batch writes its outcomes under its id,
    overwriting what an earlier attempt of the same batch left, so a replay changes nothing. Scans that fail (rc 2 or 4)
    are written, in the same way, to a second source of the stream: they come back with the next run, whether or not the
    file is listed again. ``manifest``: identities done before the stream began."""
    spark = listing.sparkSession
    folder = lambda kind, *more: "/".join([root, kind, *map(str, more)])
    path, fs = _place(spark, folder("retries"))
    fs.mkdirs(path)
    due = spark.readStream.schema(f"path string, {SEEN}").option("recursiveFileLookup", "true").parquet(folder("retries"))
    fresh = listing if manifest is None else listing.join(manifest.select(*IDENTITY), IDENTITY, "left_anti")
    both = fresh.select("path", F.unix_micros("modificationTime").alias("micros"), "length", F.lit(False).alias("retry")).unionByName(
        due.withColumn("retry", F.lit(True)))

    def commit(batch, batch_id):
        todo = batch.select("path", F.timestamp_micros("micros").alias("modificationTime"), "length")
        scan(todo).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(folder("outcomes", batch_id))
        done = spark.read.parquet(folder("outcomes", batch_id))
        failed = done.where(F.col("rc").isin(*FAILED)).select("path", F.unix_micros("modificationTime").alias("micros"), "length")
        failed.write.mode("overwrite").parquet(folder("retries", batch_id))
    q = (changed_files(both).writeStream.foreachBatch(commit).outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    """Every scan so far, with its batch_id."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/outcomes")


def stream_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Identities of files whose scan went well, as ``new_files`` takes them."""
    return outcomes(spark, root).where(~F.col("rc").isin(*FAILED)).select(*IDENTITY).distinct()


# ---- I2 --------------------------------------------------------------------------------------------------

def running_totals(stream: DataFrame) -> DataFrame:
    """Class totals over arriving rows (class, n_bytes, dim). Works on a batch and on a stream
    (update or complete mode); state is one row per class."""
    return stream.groupBy("class").agg(F.count(F.lit(1)).alias("n_assets"), F.sum("n_bytes").alias("n_bytes"),
                                       F.max("dim").alias("max_dim"))


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.makeQualified(p), fs


def current_version(spark: SparkSession, root: str):
    """The version that readers see; None before the first."""
    path, fs = _place(spark, f"{root}/current")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return int(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, root: str, version: int) -> None:
    """Moves the pointer by one atomic rename."""
    path, fs = _place(spark, f"{root}/current")
    new, _ = _place(spark, f"{root}/current.{version}")
    out = fs.create(new, True)
    out.writeBytes(str(version))
    out.close()
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf).rename(new, path, options)


def upsert_totals(batch: DataFrame, batch_id: int, root: str) -> None:
    """One batch of changed classes into the versioned totals below ``root``.

    The new version is the current one without the batch's classes, plus the batch; it becomes visible when the pointer
    moves. A batch whose id the pointer has reached is a replay and changes nothing; one that failed before writes its
    version anew. The version before stays for readers that began with it."""
    spark, at = batch.sparkSession, current_version(batch.sparkSession, root)
    if at is not None and at >= batch_id:
        return
    batch = batch.persist()
    try:
        new = batch
        if at is not None:
            changed = batch.select(F.col("class").alias("_class"))
            old = spark.read.schema(batch.schema).parquet(f"{root}/v={at}")
            new = old.join(changed, old["class"].eqNullSafe(changed["_class"]), "left_anti").unionByName(batch)
        new.write.mode("overwrite").parquet(f"{root}/v={batch_id}")
    finally:
        batch.unpersist()
    _publish(spark, root, batch_id)
    top, fs = _place(spark, root)
    for f in fs.listStatus(top):
        name = f.getPath().getName()
        if name.startswith("v=") and at is not None and int(name[2:]) < at:
            fs.delete(f.getPath(), True)


def drain(totals: DataFrame, checkpoint: str, root: str):
    """Run a totals stream over everything that has arrived; each batch carries only the classes that changed."""
    q = (totals.writeStream.outputMode("update").foreachBatch(lambda batch, i: upsert_totals(batch, i, root))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_totals(spark: SparkSession, root: str) -> DataFrame:
    """The current totals."""
    at = current_version(spark, root)
    if at is None:
        return spark.createDataFrame([], "class string, n_assets long, n_bytes long, max_dim long")
    return spark.read.parquet(f"{root}/v={at}").select("class", "n_assets", "n_bytes", "max_dim")
