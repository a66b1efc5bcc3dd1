"""Registered queries against their oracle SQL. A representative set by default; every query with
ASSETLAKE_ALL_ORACLES=1 (or tools/check_oracle.py at any scale)."""
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as E  # noqa: E402
from assetlake.registry.views import TABLES  # noqa: E402
from check_oracle import norm  # noqa: E402

CORE = [
    "A2_corpus_totals", "A7_fingerprint_chara", "A8_part_summary", "A11_container_rollup", "A12_batch_summary", "G2_block_mean_premul",
    "G4_area_resample", "G6_unsharp_edge_aware", "G7_cas", "G14_predictor_choice", "I2_running_totals", "J3_asset_shaders",
    "J9_missed_rules", "J10_match_score", "J11_similar_containers", "J12_sharing_pairs", "K2_preset_json", "P7_signatures_chara",
    "P13_parse_rule_spec", "P20_translate_terms", "Q2_parts_report", "Q4_plan_corpus", "R1_resolve_rules", "R2_merge_owner_rules",
    "R8_choose_candidate", "S1_list_corpus", "S3_bindings", "S6_read_rules", "W4_order_assets", "W7_dedupe_names", "X5_coverage_audit",
]
NAMES = sorted(E.oracle_sql()) if os.environ.get("ASSETLAKE_ALL_ORACLES") else CORE


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, small, name):
    df = E.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=str)
    rel = duck.execute(E.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=str)
    assert got == want


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
