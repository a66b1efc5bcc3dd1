"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the first four return the columns of documents, the last
the mix. ``run`` writes what a stage returns to the shared folder and reads it for the next one.
"""
from pyspark.sql import functions as F

from assetlake.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from assetlake.llm.common import materialise, row_key


def apply_quality_rules(spark, docs, sf_dir):
    """Documents that the base or a rule of the cascade rejects go. Null and empty texts are rejected."""
    return docs.where(quality.judge_column(docs))


def drop_common_lines(spark, docs, sf_dir):
    """Lines of 40 and more characters in five and more documents stay only in the largest doc_id that holds them. Every
    document stays, those that lose lines with a new text (empty if nothing is left) and n_chars."""
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    chars = F.when(F.col("dropped") > 0, F.char_length("kept")).otherwise(F.col("row")["n_chars"])
    new = {"text": F.col("kept"), "n_chars": chars.cast(docs.schema["n_chars"].dataType)}
    return kept.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group with five-word shingle similarity of 0.8 or more stays: the smallest doc_id (null last;
    of rows that share it the smallest hash of the text). Documents without words stay. Equal rows become one."""
    found = near_dedup.near_duplicates(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    kept = found.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(order).alias("o")).select("o.doc_id", "o.row_key")
    kept = materialise(kept.unionByName(found.where(F.col("group").isNull()).select("doc_id", "row_key").distinct()))
    kept = kept.select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_row"))
    keys = docs.select("doc_id", row_key().alias("row_key"))
    if keys.count() > keys.distinct().count():
        docs = docs.dropDuplicates(["doc_id", "text"])
    same = docs["doc_id"].eqNullSafe(kept["_doc"]) & row_key(docs["text"]).eqNullSafe(kept["_row"])
    return docs.join(kept, same, "left_semi")


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold ten consecutive words of a benchmark item (a shorter item whole) go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_targets(spark, docs, sf_dir):
    """The documents in the mix with their copies; those of which no word is taken go."""
    return mixing.mix_sources(docs).where(F.col("taken") > 0)


STAGES = [
    ("quality rules", apply_quality_rules),
    ("line dedup", drop_common_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_targets),
]

#: The dual of the last stage is solved by iteration, which SQL does not express.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
