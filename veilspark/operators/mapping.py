"""Stable placeholders for entities.

Defined results: an entity without original is never mapped; unknown actions mean redact and unknown strategies none; of several decisions
for one candidate the one that is greatest by action and strategy counts; repeated rows count once."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.numbering import number_within
from veilspark.functions.text import candidate_id, letters
from veilspark.operators.rules import STRATEGIES

ITEM_FIELDS = ["candidate_id", "kind", "original", "placeholder", "replacement", "strategy", "default_strategy", "preservation_value"]


def normalize_decisions(decisions: DataFrame) -> DataFrame:
    """(project_id, candidate_id, action, strategy): one row for each candidate, with known actions and strategies only."""
    d = decisions.filter("candidate_id is not null").select(
        "project_id", "candidate_id", F.when(F.col("action").isin("redact", "keep"), F.col("action")).otherwise("redact").alias("action"), F.when(F.col("strategy").isin(*STRATEGIES), F.col("strategy")).alias("strategy")
    )
    return d.groupBy("project_id", "candidate_id").agg(F.max(F.struct("action", "strategy")).alias("d")).select("project_id", "candidate_id", "d.action", "d.strategy")


def decided(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entities with candidate_id, the decision's action and strategy (d_action, d_strategy) and whether they are kept."""
    e = entities.filter("original is not null and original <> '' and kind is not null").withColumn("candidate_id", candidate_id(F.col("kind"), F.col("original")))
    d = normalize_decisions(decisions).select("project_id", "candidate_id", F.col("action").alias("d_action"), F.col("strategy").alias("d_strategy"))
    x = e.join(d, ["project_id", "candidate_id"], "left")
    kept = (F.coalesce("d_action", F.lit("")) == "keep") | ((F.col("strategy") == "keep") & (F.coalesce("d_action", F.lit("")) != "redact"))
    return x.withColumn("kept", kept)


def build_mapping(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Mapping items (project_id, ord, ITEM_FIELDS): placeholders lettered within project and prefix in the order of ``entities.ord``."""
    x = decided(entities, decisions).filter(~F.col("kept"))
    x = number_within(x, ["project_id", "placeholder_prefix"], ["ord", "kind", "original"], "seq")
    strategy = F.coalesce("d_strategy", F.when(F.col("strategy") == "keep", "mask").otherwise(F.col("strategy")))
    placeholder = F.concat(F.coalesce("placeholder_prefix", F.lit("")), letters(F.col("seq")))
    x = x.select("project_id", "ord", "candidate_id", "kind", "original", placeholder.alias("placeholder"), strategy.alias("s"), F.col("strategy").alias("default_strategy"), "replacement_hint")
    ranged = F.col("s") == "range"
    return x.select(
        "project_id", "ord", "candidate_id", "kind", "original", "placeholder",
        F.when(ranged & F.col("replacement_hint").isNotNull() & (F.col("replacement_hint") != ""), F.concat("placeholder", F.lit("（"), "replacement_hint", F.lit("）"))).otherwise(F.col("placeholder")).alias("replacement"),
        F.col("s").alias("strategy"), "default_strategy", F.when(ranged, F.col("replacement_hint")).alias("preservation_value"),
    )


def placeholder_prefix(items: DataFrame) -> DataFrame:
    """Items with ``prefix``, their placeholder without its letters and range."""
    bare = F.regexp_replace("placeholder", "（[^）]*）$", "")
    return items.withColumn("prefix", F.when(bare.rlike("^.*?[A-Z]+$"), F.regexp_extract(bare, "^(.*?)([A-Z]+)$", 1)).otherwise(bare))


def merge_mapping(items: DataFrame, entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items with those of new originals appended; nothing is renumbered. New letters go on from the count of the prefix, over used ones.

    Candidates for letters are as many numbers as there are new and used items of a prefix, so gaps are filled without a loop."""
    old = placeholder_prefix(items.dropDuplicates(["project_id", "candidate_id"]))
    first = decided(entities, decisions).groupBy("project_id", "original").agg(F.min(F.struct("ord", "kind")).alias("f")).select("project_id", "original", "f.ord", "f.kind")
    new = decided(entities, decisions).join(first, ["project_id", "original", "ord", "kind"], "left_semi").join(old.select("project_id", "original"), ["project_id", "original"], "left_anti").filter(~F.col("kept"))
    new = number_within(new, ["project_id", "placeholder_prefix"], ["ord", "kind", "original"], "rank")
    have = old.groupBy("project_id", F.col("prefix").alias("placeholder_prefix")).agg(F.count("*").alias("have"))
    want = new.groupBy("project_id", "placeholder_prefix").agg(F.count("*").alias("want")).join(have, ["project_id", "placeholder_prefix"], "left")
    slots = want.select("project_id", "placeholder_prefix", F.explode(F.sequence(F.coalesce("have", F.lit(0)) + 1, 2 * F.coalesce("have", F.lit(0)) + F.col("want"))).alias("slot"))
    slots = slots.withColumn("placeholder", F.concat("placeholder_prefix", letters(F.col("slot")))).join(old.select("project_id", "placeholder"), ["project_id", "placeholder"], "left_anti")
    free = number_within(slots, ["project_id", "placeholder_prefix"], ["slot"], "rank").select("project_id", "placeholder_prefix", "rank", "placeholder")
    x = new.join(free, ["project_id", "placeholder_prefix", "rank"])
    strategy = F.coalesce("d_strategy", F.when(F.col("strategy") == "keep", "mask").otherwise(F.col("strategy")))
    ranged = strategy == "range"
    added = x.select(
        "project_id", "ord", "candidate_id", "kind", "original", "placeholder",
        F.when(ranged & F.col("replacement_hint").isNotNull(), F.concat("placeholder", F.lit("（"), "replacement_hint", F.lit("）"))).otherwise(F.col("placeholder")).alias("replacement"),
        strategy.alias("strategy"), F.col("strategy").alias("default_strategy"), F.when(ranged, F.col("replacement_hint")).alias("preservation_value"), F.lit(True).alias("added"),
    )
    return old.select("project_id", "ord", *ITEM_FIELDS, F.lit(False).alias("added")).unionByName(added)


def mapping_stats(items: DataFrame) -> DataFrame:
    """Public counts by kind; values stay private."""
    return items.dropDuplicates(["project_id", "candidate_id"]).groupBy("project_id", "kind").agg(F.count("*").alias("n"))


def mapping_hash(items: list[dict]) -> str:
    """The hash of one project's items in their order, as of JSON with sorted keys; for a mapping that the driver writes out."""
    return hashlib.sha256(json.dumps(items, ensure_ascii=False, sort_keys=True).encode("utf-8")).hexdigest()
