"""Incremental arrival, invariance to partitioning, and plan shape."""
import shutil

from helpers import container, png, rows
from pyspark.sql import functions as F

from assetlake.operators import ordering as W
from assetlake.operators import resolve as R
from assetlake.registry import QUERIES
from assetlake.registry.views import Views
from assetlake.sources import containers as C
from assetlake.sources import corpus
from assetlake.streaming import incremental as I


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_second_scan_finds_nothing_and_failures_are_retried(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(container({1: png()}))
    (tmp_path / "b.png").write_bytes(b"junk")
    files = corpus.list_corpus(spark, str(tmp_path), content=True)
    inv = C.inventory(C.inventory_records(files))
    manifest = I.manifest_rows(files, inv["containers"])
    assert [r.path.rsplit("/", 1)[1] for r in I.new_files(files, manifest).collect()] == ["b.png"]
    (tmp_path / "b.png").write_bytes(container())
    inv2 = C.inventory(C.inventory_records(corpus.list_corpus(spark, str(tmp_path), content=True)))
    again = corpus.list_corpus(spark, str(tmp_path))
    assert I.new_files(again, I.manifest_rows(again, inv2["containers"])).count() == 0


def test_stream_totals_equal_batch_as_files_arrive(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    schema = "class string, n_bytes long, dim int"
    data = [("maintex", 5, 10), ("mask", 7, 20), ("maintex", 11, 5), ("other", 1, 1)]
    for i, part in enumerate((data[:2], data[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        for f in (tmp_path / f"b{i}").glob("*.parquet"):
            shutil.copy(f, src / f"{i}.parquet")
        I.drain(I.running_totals(spark.readStream.schema(schema).parquet(str(src))), ck, out)
    want = I.running_totals(spark.createDataFrame(data, schema))
    assert rows(I.read_totals(spark, out)) == rows(want)
    assert I.current_version(spark, out) == 1


def totals(spark, *data):
    return spark.createDataFrame(data, "class string, n_assets long, n_bytes long, max_dim int")


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "totals")
    assert I.current_version(spark, root) is None and I.read_totals(spark, root).count() == 0
    I.upsert_totals(totals(spark, ("a", 1, 1, 1), (None, 2, 2, 2)), 0, root)
    I.upsert_totals(totals(spark, (None, 5, 5, 5), ("b", 3, 3, 3)), 1, root)
    want = {("a", 1, 1, 1), (None, 5, 5, 5), ("b", 3, 3, 3)}
    assert {tuple(r) for r in I.read_totals(spark, root).collect()} == want
    for again in (0, 1):
        I.upsert_totals(totals(spark, ("a", 9, 9, 9)), again, root)
    assert {tuple(r) for r in I.read_totals(spark, root).collect()} == want and I.current_version(spark, root) == 1
    before = I.read_totals(spark, root)
    totals(spark, ("half", 1, 1, 1)).write.parquet(root + "/v=2")  # an attempt that failed before the pointer moved
    assert {tuple(r) for r in I.read_totals(spark, root).collect()} == want
    I.upsert_totals(totals(spark, ("a", 7, 7, 7)), 2, root)
    assert {tuple(r) for r in I.read_totals(spark, root).collect()} == want - {("a", 1, 1, 1)} | {("a", 7, 7, 7)}
    assert {tuple(r) for r in before.collect()} == want  # readers of the version before go on
    assert sorted(p.name for p in (tmp_path / "totals").glob("v=*")) == ["v=1", "v=2"]


def test_stream_scans_new_changed_and_failed_files(spark, tmp_path):
    from datetime import datetime, timezone
    at = lambda n: datetime(2024, 1, 1, 0, 0, n, tzinfo=timezone.utc)
    schema, root, listings = "path string, modificationTime timestamp, length long", str(tmp_path / "scans"), str(tmp_path / "listings")
    known = spark.createDataFrame([("old", at(0), 1)], schema)

    def run(k, rows_, bad=()):
        if rows_:
            spark.createDataFrame(rows_, schema).write.parquet(f"{listings}/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(listings)
        scan = lambda d: d.withColumn("rc", F.when(F.col("path").isin(*bad), 2).otherwise(0))
        I.scan_arrivals(stream, scan, root, str(tmp_path / "ck"), known)
        return sorted((r.path, r.length) for r in I.outcomes(spark, root).where(F.col("batch_id") == k).collect())
    assert run(0, [("a", at(1), 5), ("b", at(1), 6), ("old", at(0), 1), ("a", at(1), 5)], bad=["b", "none"]) == [("a", 5), ("b", 6)]
    assert run(1, [("a", at(1), 5), ("b", at(1), 6), ("c", at(2), 7)], bad=["b", "c"]) == [("b", 6), ("c", 7)]
    assert run(2, [("a", at(3), 5), ("c", at(2), 8), ("c", at(2), 7)], bad=["none"]) == [("a", 5), ("b", 6), ("c", 8)]
    assert run(3, [("a", at(3), 5), ("b", at(1), 6)], bad=["none"]) == []
    assert {(r.path, r.length) for r in I.stream_manifest(spark, root).collect()} == {("a", 5), ("b", 6), ("c", 8)}


def test_a_path_listed_once_goes_on_as_it_came():
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, seen):
            self.exists, self.get = True, seen
    state, frame = State(), lambda *rows_: pd.DataFrame([("a", *r) for r in rows_], columns=["path", "micros", "length"])
    step = lambda *frames: [tuple(r) for f in I._newest_if_changed(("a",), iter(frames), state) for r in f.itertuples(index=False)]
    once = frame((5, 7))
    assert next(I._newest_if_changed(("a",), iter([once]), state)) is once and state.get == (5, 7)
    assert step(frame((5, 7))) == [] and step(frame((5, 7), (5, 6)), frame((4, 9))) == []
    assert step(frame((5, -8))) == [("a", 5, 7)] and step(frame((5, 7), (5, -8))) == [("a", 5, 7)]
    assert step(frame((4, 0), (5, -8))) == [("a", 4, 0)] and step(frame((3, 1))) == [("a", 3, 1)] and state.get == (3, 1)
    state.exists = False
    assert step(frame((2, -1), (2, -4))) == [("a", 2, 3)] and state.get == (2, 3)


def test_file_stream_lists_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.png").write_bytes(png())
    s = I.stream_files(spark, str(tmp_path / "in"))
    q = (s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1


def test_results_do_not_depend_on_partitioning(spark, small):
    base = None
    for n in ("1", "8", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = rows(QUERIES["Q4_plan_corpus"](spark, small)), rows(QUERIES["Q3_group_report"](spark, small))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        base = base or got
        assert got == base


def test_detail_cap_filters_before_the_exchange(spark, small):
    p = plan(W.cap_details(Views(spark, small).events, 12, ["user_id", "event_type"], ["ts", "event_id"]))
    assert p.count("WindowGroupLimit") == 2


def test_class_plan_is_broadcast_by_its_size_and_assets_are_not_shuffled_by_class(spark):
    assets = spark.range(1000).select((F.col("id") % 9).cast("string").alias("class"), "id")
    one = R.builtin_plans(spark).where("plan_id = 'quality'").drop("plan_id")
    p = plan(R.rules_by_class(assets, one))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_no_cartesian_product_in_any_plan(spark, small):
    bad = []
    for name, fn in QUERIES.items():
        p = plan(fn(spark, small))
        if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p:
            bad.append(name)
    assert not bad


def test_scans_read_only_needed_columns(spark, small):
    p = plan(QUERIES["A13_payload_totals"](spark, small))
    schema = p.split("ReadSchema: ")[1].split("\n")[0]
    assert "o_orderpriority" not in schema and "o_totalprice" in schema
