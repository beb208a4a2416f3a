"""Gates of an external release: each file is either allowed or blocked with one fixed reason code.

Defined results: missing evidence blocks; the first reason in the order of checks counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKING = ["embedded_object", "binary_media", "unknown_part", "external_relationship", "hidden_sheet", "very_hidden_sheet", "comment"]
TEXT_TYPES = ["txt", "md"]
OFFICE_TYPES = ["docx", "xlsx"]


def package_gate(residual_status: Column, hits: Column, evidence: Column, sources: Column, expected_hash: Column, actual_hash: Column) -> Column:
    """The reason that blocks a whole package, or null."""
    return (
        F.when((F.coalesce(residual_status, F.lit("")) != "clear") | (F.coalesce(hits, F.lit(-1)) != 0), "residual_not_clear")
        .when(evidence.isNull() | (evidence != sources), "source_evidence_missing")
        .when(~F.coalesce(expected_hash, F.lit("")).rlike("^[0-9a-f]{64}$") | (F.coalesce(expected_hash, F.lit("")) != F.coalesce(actual_hash, F.lit("-"))), "mapping_hash_mismatch")
    )


def file_gate(file_type: Column, parser_status: Column, channel_status: Column, kinds: Column, writer: bool = False) -> Column:
    """The reason that blocks one file, or null. Office files need a validating writer; without one they stay closed."""
    kind = F.lower(F.coalesce(file_type, F.lit("")))
    bad = F.array_intersect(F.coalesce(kinds, F.array().cast("array<string>")), F.array(*[F.lit(b) for b in BLOCKING]))
    bad = F.when(kind == "docx", F.array_except(bad, F.array(F.lit("comment")))).otherwise(bad)
    return (
        F.when(kind == "pdf", "pdf_external_release_disabled")
        .when(F.coalesce(parser_status, F.lit("")) != "ok", "source_parse_not_ok")
        .when(~F.coalesce(channel_status, F.lit("")).isin("clear", "found"), "hidden_channels_unverified")
        .when(F.array_contains(bad, "external_relationship"), "external_relationship")
        .when(F.size(bad) > 0, F.array_min(bad))
        .when(kind.isin(*OFFICE_TYPES), F.lit(None if writer else "rewrite_or_validation_failed"))
        .when(~kind.isin(*TEXT_TYPES), "unsupported")
    )


def release_manifest(files: DataFrame) -> DataFrame:
    """(project_id, exported_count, blocked_count) of files with a reason column."""
    return files.groupBy("project_id").agg(F.count_if(F.col("reason").isNull()).alias("exported_count"), F.count_if(F.col("reason").isNotNull()).alias("blocked_count"))
