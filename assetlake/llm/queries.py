"""The registered queries opN_<name>: each applies its operator to the whole table and derives the digest columns."""
from pyspark.sql import functions as F

from assetlake.llm import (decontaminate, hard_negatives, html_extract, license_scan, line_dedup, lm_score, mixing, near_dedup, phrase_dedup, pii,
                           quality, secret_scan, vector_codes)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark, sf_dir):
    m = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_lm_scores(spark, sf_dir):
    return lm_score.score_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "score")


def op3_pii_surrogates(spark, sf_dir):
    return pii.replace_entities(table(spark, sf_dir, "documents")).select("doc_id", "n_entities", "text")


def op4_quality_rules(spark, sf_dir):
    q = quality.quality_rules(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_extract_html(spark, sf_dir):
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_minhash_near_dedup(spark, sf_dir):
    n = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4)
    return n.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_find_secrets(spark, sf_dir):
    s = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in secret_scan.KINDS])
    count = lambda k: F.size(F.filter("base", lambda b: b.kind == k)).cast("long")
    ordered = lambda c: F.array_sort(F.transform(c, lambda b: F.struct(b.start.alias("start"), b.kind.alias("kind"), b.end.alias("end"))))
    said = lambda c: F.array_join(F.transform(ordered(c), lambda b: F.concat_ws(":", names[b.kind], b.start, b.end)), ",")
    return s.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                    F.sha2(said("base"), 256).alias("base_sha256"), said(F.concat("base", "inferred")).alias("spans"))


def op8_decontaminate(spark, sf_dir):
    found = decontaminate.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op9_phrase_dedup(spark, sf_dir):
    texts, removed = phrase_dedup.repeated_phrases(table(spark, sf_dir, "documents"))
    r = removed.select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_r"), "n_removed", F.sha2("kept", 256).alias("_sha")).dropDuplicates(["_d", "_r"])
    j = texts.join(r, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row_key") == F.col("_r")), "left")
    return j.select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                    F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256"))


def op10_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("row.doc_id", F.col("lines").alias("n_lines"), F.col("dropped").alias("n_dropped"),
                       F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op11_hard_negatives(spark, sf_dir):
    e, ident = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    label = F.when(ident % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(e.withColumn("label", label), ident % 50 == 0)


def op12_license_scan(spark, sf_dir):
    s = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    said = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, found = F.transform("base", lambda b: b.label), F.transform("blocks", lambda b: b.label)
    starts = F.transform("base", lambda b: b.word)
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b.containment)), F.lit(0.0)))
    return s.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                    F.array_max(starts).alias("last_word"), said(base).alias("base_labels"), said(F.concat(base, found)).alias("labels"),
                    score.alias("score"))


def op13_vector_codes(spark, sf_dir):
    coded, books = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_errors(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_lm_scores, op3_pii_surrogates, op4_quality_rules, op5_extract_html, op6_minhash_near_dedup, op7_find_secrets, op8_decontaminate,
    op9_phrase_dedup, op10_line_dedup, op11_hard_negatives, op12_license_scan, op13_vector_codes)}
