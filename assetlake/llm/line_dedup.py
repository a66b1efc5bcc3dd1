"""Line dedup: lines found in many documents stay only in the last document that holds them.

Text never moves for the decision: a line travels as two 64-bit hashes, its document and its position. The hashes are
range-partitioned together with the document (so one line of a third of all documents spreads over many partitions),
sorted by document and position, and streamed in that order: the window passes on a line's first occurrence in each
document and nothing else, so what is counted by line are documents. These counts combine before their exchange, and
a line that very many rows share is dealt over salts when its rows learn the answer. The result is a compressed bitmap
of the kept lines for each document that loses some: the 64-line words with a gap, each with its bits.
"""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlake.llm.common import WS, materialise, row_key, whole
from assetlake.operators.skew import salted_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
H = ["_h1", "_h2"]


def line_key(line):
    """The line without white space at both ends, A-Z in lower case (other letters stay as they are)."""
    line = F.btrim(line, F.lit(WS))
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row (doc_id, row_key, keep) for each document that loses lines. ``keep`` is an array of (word, bits): bit i of
    bits is set when line 64 * word + i stays. Words that are not in it stay whole, as do documents without a row.

    Rows with a null doc_id count as one document that comes before all others. Rows that share a doc_id count as one
    document; each has its own bitmap. Null and empty texts have no line long enough to go. Extra columns are ignored.
    """
    d = docs.select(F.col("doc_id").alias("_doc"), row_key().alias("_row"), whole().alias("_text"))
    lines = d.select("_doc", "_row", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    keyed = lines.withColumn("_key", line_key(F.col("_line"))).where(F.char_length("_key") >= min_chars)
    keyed = materialise(keyed.select(F.xxhash64(F.lit(1), "_key").alias("_h1"), F.xxhash64(F.lit(2), "_key").alias("_h2"),
                                     "_doc", "_row", "_pos"))
    nth = F.row_number().over(Window.partitionBy(*H, "_doc").orderBy("_pos"))  # the range partitions hold these groups whole
    firsts = keyed.repartitionByRange(*H, "_doc").withColumn("_nth", nth).where("_nth = 1")
    common = firsts.groupBy(*H).agg(F.count("*").alias("_docs"), F.max("_doc").alias("_keeper"))
    common = common.where(F.col("_docs") >= min_docs).select(*H, "_keeper")
    gone = salted_join(keyed, common, H, ["_doc", "_pos"]).where(~F.col("_doc").eqNullSafe(F.col("_keeper")))
    words = gone.groupBy("_doc", "_row", F.shiftright("_pos", 6).alias("word")).agg(
        F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, _pos % 64)"))).alias("bits"))
    return words.groupBy(F.col("_doc").alias("doc_id"), F.col("_row").alias("row_key")).agg(
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: ``row`` (a struct of all its columns), ``lines`` (lines before), ``dropped`` (lines
    that went) and ``kept`` (the text that stays; the null text of a document that loses nothing stays null)."""
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc"), F.col("text").alias("text"),
                    row_key().alias("key"))
    b = bitmaps.select(F.col("doc_id").alias("b_doc"), F.col("row_key").alias("b_key"), F.col("keep").alias("bits"))
    j = d.join(b, F.col("doc").eqNullSafe(F.col("b_doc")) & F.col("key").eqNullSafe(F.col("b_key")), "left")
    gone = F.expr("aggregate(bits, 0L, (n, w) -> n + 64 - bit_count(w.bits))")
    stay = F.expr("""array_join(transform(filter(transform(split(text, '\n'), (x, i) -> struct(x AS x, i AS i)),
        e -> (coalesce(try_element_at(words, e.i div 64), -1L) & shiftleft(1L, e.i % 64)) <> 0), e -> e.x), '\n')""")
    j = j.withColumn("words", F.expr("map_from_entries(transform(bits, w -> struct(CAST(w.word AS BIGINT), w.bits)))"))
    none = F.col("bits").isNull()
    return j.select("row", F.size(F.split(whole(), "\n")).cast("long").alias("lines"),
                    F.when(none, F.lit(0).cast("long")).otherwise(gone).alias("dropped"),
                    F.when(none, F.col("text")).otherwise(stay).alias("kept"))
