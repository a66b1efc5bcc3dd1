"""The pipeline's stages on their own input, and its end."""
from collections import Counter

import cases
import corpus_pipeline as P
from pyspark.sql import functions as F

from assetlake.llm import mixing
from assetlake.llm.queries import QUERIES


def stage(k):
    return P.STAGES[k][1]


def test_stages(spark, docs, rows, small):
    names = [n for n, _ in P.STAGES]
    assert names == ["quality rules", "line dedup", "near dedup", "decontamination", "mixing"]
    for k in range(4):
        out = stage(k)(spark, docs, small)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    kept = Counter(r.doc_id for r in stage(0)(spark, docs, small).collect())
    good = Counter(d for d, t, _ in rows if not cases.quality(t)[5])
    assert kept == good  # invented prose breaks no rule of the cascade
    lines = stage(1)(spark, docs, small).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256), "n_chars", F.char_length("text")).collect()
    assert Counter((r[0], r[1]) for r in lines) == Counter((d, s) for d, _, _, s in cases.lines(rows)) and all(r[2] == r[3] for r in lines)
    _, group = cases.components(rows, 5)
    words = [len(cases.WORD.findall(t or "")) for _, t, _ in rows]
    want = Counter(min((d is None, d or 0) for i, (d, _, _) in enumerate(rows) if group[i] == g) for g in {g for i, g in enumerate(group) if words[i]})
    want += Counter((d is None, d or 0) for (d, _, _), n in zip(rows, words) if not n)
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in stage(2)(spark, docs, small).collect()) == want
    mix = stage(4)(spark, docs, small).collect()
    all_of = mixing.mix_sources(docs).where("taken > 0").collect()
    assert Counter(map(tuple, mix)) == Counter(map(tuple, all_of))


def test_empty(spark, none, small):
    for _, f in P.STAGES:
        assert f(spark, none, small).count() == 0


def test_run_follows_its_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, f in P.STAGES:
        docs = f(spark, docs, small)
    assert Counter(map(tuple, P.run(spark, small).collect())) == Counter(map(tuple, docs.collect()))


def test_registered():
    import __spark_entry__ as E

    names = [n for n in E.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([f"op{i}" for i in (1, 4, 5, 6, 7, 8, 9, 10)] + ["pipeline"]) or len(names) == len(QUERIES) + 1
