"""One co-partitioned store of assets and bindings, and the preset layer of rule resolution on it: J8, R3 (and R1, R2).

``write_facts`` writes both tables once, bucketed and sorted by (container_id, asset_id) into the same number of buckets.
From then on whatever groups or joins by the asset key finds its rows in place: profiles (R1, R2), signature sets, id tokens
and the last join of every layer run without an exchange on that key. What still moves are ids to the preset rules that carry
them, and what they hit back to the asset (``rule_units``).
"""
import os
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.functions import keys, text
from assetlake.operators import rule_units
from assetlake.schemas import ASSET_KEY
from assetlake.session import shared_dir


class Facts(NamedTuple):
    assets: DataFrame
    bindings: DataFrame  # with sig, the signature of each binding


def _bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """``df`` lies in ``buckets`` partitions by the asset key."""
    spark = df.sparkSession
    (df.write.bucketBy(buckets, *ASSET_KEY).sortBy(*ASSET_KEY)
     .option("path", os.path.join(shared_dir(spark), name)).saveAsTable(name))
    return spark.table(name)


def write_facts(assets: DataFrame, bindings: DataFrame, buckets: int = None, repeated: bool = False) -> Facts:
    """Both tables in the shared folder, under names of their own. ``buckets``: as many as the session shuffles into by
    default; choose it for bucket files of some hundred megabytes. ``repeated``: rows of an asset key may repeat in ``assets``;
    the first is kept. Rows move once: repeats go and signatures come after that."""
    spark = assets.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "assetlake_facts_" + uuid.uuid4().hex
    sig = text.signature(keys.owner_key(F.col("obj_type"), F.col("slot")), F.col("material"), F.col("property"))
    a, b = (df.repartition(n, *ASSET_KEY) for df in (assets, bindings))
    return Facts(_bucketed(a.dropDuplicates(ASSET_KEY) if repeated else a, name + "_assets", n),
                 _bucketed(b.withColumn("sig", sig), name + "_bindings", n))


def drop_facts(facts: Facts) -> None:
    """Forgets the tables; their files lie in the shared folder like those of ``cut_lineage``."""
    for df in facts:
        name = df.inputFiles()[0].rsplit("/", 2)[1] if df.inputFiles() else None
        if name:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def asset_signatures(facts: Facts) -> DataFrame:
    """A6 on the store: distinct (container_id, asset_id, sig)."""
    return facts.bindings.select(*ASSET_KEY, "sig").distinct()


def match_asset_rules(facts: Facts, asset_rules: DataFrame, runs: DataFrame = None) -> DataFrame:
    """J8 on the store: distinct (container_id, asset_id, preset_id, rule_no) hits. A common signature is a hit; equal ids are
    one only when either side has no signatures at all. ``runs`` as in presets.match_asset_rules."""
    return rule_units.match_asset_rules(facts.assets, facts.bindings, asset_rules, runs)


def preset_asset_rules(facts: Facts, asset_rules: DataFrame, runs: DataFrame = None) -> DataFrame:
    """R3 on the store: one merged rule for each asset that any rule recognises (container_id, asset_id, asset_rule)."""
    return merge_preset_hits(facts, asset_rules, runs).drop("n_hits")


def merge_preset_hits(facts: Facts, asset_rules: DataFrame, runs: DataFrame = None) -> DataFrame:
    """R3 on the store with the number of hits (container_id, asset_id, asset_rule, n_hits)."""
    return rule_units.merge_hits(facts.assets, facts.bindings, asset_rules, runs)


def missed_counts(facts: Facts, asset_rules: DataFrame, runs: DataFrame) -> DataFrame:
    """J9 on the store as a complement: (container_id, preset_id, n_rules, n_missed) for each run."""
    return rule_units.missed_counts(facts.assets, facts.bindings, asset_rules, runs)


def missed_rules(facts: Facts, asset_rules: DataFrame, runs: DataFrame, asked: DataFrame = None) -> DataFrame:
    """(container_id, preset_id, rule_no) of rules that found nothing, for the containers of ``asked`` (container_id; None:
    for all runs)."""
    if asked is not None:
        runs = runs.join(asked.select("container_id"), "container_id", "left_semi")
    return rule_units.missed_rules(facts.assets, facts.bindings, asset_rules, runs)


def fingerprint(facts: Facts) -> DataFrame:
    """A7 (plain containers) on the store: signatures of containers, one row for each asset that carries one. Not distinct:
    whoever counts them must."""
    return facts.bindings.select("container_id", "sig")
