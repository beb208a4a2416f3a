"""What people and other systems see of a redaction: review candidates, packages, sandbox imports and batch manifests.

Defined results: originals and mappings never enter a public frame; repeated rows count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.numbering import number_within
from veilspark.operators.audit import base_level, impact_domain


def review_hint(kind: Column, strategy: Column) -> Column:
    return (
        F.when(kind == "amount", "prefer_range")
        .when(kind.isin("technical_metric", "validation_evidence"), "prefer_keep")
        .when(kind.isin("project_name", "organization", "contract_id", "phone", "email"), "identity")
        .when(kind == "patent_id", "keep_kind_and_count")
        .when(strategy == "range", "prefer_range")
        .otherwise("review")
    )


def workspace_candidates(entities: DataFrame) -> DataFrame:
    """One candidate for each entity, with its recommended action, hint and impact."""
    from veilspark.functions.text import candidate_id

    e = entities.filter("original <> '' and kind is not null").dropDuplicates(["project_id", "kind", "original"])
    kind, strategy = F.col("kind"), F.col("strategy")
    return e.select(
        "project_id", candidate_id(kind, F.col("original")).alias("candidate_id"), "kind", strategy.alias("default_strategy"), F.when(strategy == "keep", "keep").otherwise("redact").alias("recommended_action"),
        F.coalesce("placeholder_prefix", F.lit("")).alias("placeholder_prefix"), review_hint(kind, F.coalesce("strategy", F.lit(""))).alias("review_hint"), impact_domain(kind).alias("impact_domain"), base_level(kind).alias("impact_level"),
    )


def review_candidates(items: DataFrame, impacts: DataFrame) -> DataFrame:
    """Mapping items, and the impact items that were kept, as candidates."""
    m = items.dropDuplicates(["project_id", "candidate_id"]).select("project_id", "candidate_id", "kind", "placeholder", "replacement", "strategy", "preservation_value", base_level(F.col("kind")).alias("impact_level"))
    k = impacts.join(m, ["project_id", "candidate_id"], "left_anti").select("project_id", "candidate_id", "kind", F.lit("").alias("placeholder"), F.lit("").alias("replacement"), F.coalesce("strategy", F.lit("keep")).alias("strategy"), F.lit(None).cast("string").alias("preservation_value"), "impact_level")
    return m.unionByName(k)


def number_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with block_id blk_0001, ... in the order of files and blocks of their project."""
    return number_within(blocks, ["project_id"], ["file_ord", "block_ord"], "n").withColumn("block_id", F.format_string("blk_%04d", "n")).drop("n")


def sandbox_files(files: DataFrame) -> DataFrame:
    """The public columns of a project's files, each file once: neither originals nor mappings."""
    return files.dropDuplicates(["project_id", "file_ord"]).select("project_id", "file_name", "file_type", "file_hash", "parser_status", F.array_join(F.coalesce("warnings", F.array().cast("array<string>")), ";").alias("warnings"))


def batch_manifest(files: DataFrame, blocks: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each project of a batch: its counts."""
    f = files.dropDuplicates(["project_id", "file_ord"]).groupBy("project_id").agg(F.count("*").alias("file_count"), F.count_if(F.col("parser_status") == "ok").alias("ok_count"))
    b = blocks.groupBy("project_id").agg(F.countDistinct("block_key").alias("block_count"))
    m = items.groupBy("project_id").agg(F.countDistinct("candidate_id").alias("field_count"))
    x = f.join(b, "project_id", "left").join(m, "project_id", "left")
    return x.select("project_id", "file_count", "ok_count", F.coalesce("block_count", F.lit(0)).alias("block_count"), F.coalesce("field_count", F.lit(0)).alias("field_count"))


def restore_preview(blocks: DataFrame, chars: int = 600) -> DataFrame:
    """(project_id, preview): the first characters of a project's texts in order.

    Only the blocks that can reach into the preview are gathered: those before which fewer characters stand."""
    w = number_within(blocks.filter("text is not null"), ["project_id"], ["file_ord", "block_ord"], "n").filter(F.col("n") <= chars)
    return w.groupBy("project_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.substring("text", 1, chars).alias("t")))), lambda x: x["t"]), "\n"), 1, chars).alias("preview"))


def review_report(summary: dict, stats: list[tuple[str, int]], warnings: list[str]) -> str:
    """The Markdown report of one project."""
    lines = ["# Redaction review", "", f"- project: {summary.get('project_id', '')}", f"- gate: {summary.get('overall_level', '')}", f"- residual scan: {summary.get('residual_status', 'not_scanned')} ({summary.get('residual_hits', 0)} hits)", "", "## Fields", ""]
    lines += [f"- {k}: {n}" for k, n in stats] + ["", "## Warnings", ""] + [f"- {w}" for w in warnings]
    return "\n".join(lines) + "\n"
