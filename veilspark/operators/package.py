"""Whole projects: from texts to redacted packages and private mappings, all projects in one plan."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import audit, detect, mapping, redact, review
from veilspark.session import cut

SCHEMA = "redaction_package.v1"
FINAL_WARNING = "not_for_direct_release"


class Redaction(NamedTuple):
    entities: DataFrame
    items: DataFrame
    blocks: DataFrame
    #: (project_id, value) of the dictionary that stand in the source; null without a dictionary.
    present: DataFrame | None = None


def no_decisions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "project_id string, candidate_id string, action string, strategy string")


def redact_projects(texts: DataFrame, key: str, decisions: DataFrame | None = None, dictionary: DataFrame | None = None, channels: DataFrame | None = None) -> Redaction:
    """Entities, mapping and redacted texts of all projects in ``texts`` (project_id, key, text), ordered by key.

    ``channels`` (project_id, file_ord, text_ord, text) are texts outside the body: they add entities but are not redacted here."""
    body, present = detect.detect(texts.select("project_id", key, "text"), ["project_id"], key, "text"), None
    if dictionary is not None:
        body = cut(body)  # read twice below; detection is the costly part
        values = detect.dictionary_values(dictionary)
        present = cut(redact.present_values(texts.select("project_id", "text"), values, "project_id", "text", "value"))
        body = detect.with_dictionary(body, values.join(present, ["project_id", "value"], "left_semi"))
    if channels is None:
        entities = detect.ordered(body, ["project_id"])
    else:
        hidden = detect.detect(channels, ["project_id", "file_ord"], "text_ord", "text")
        entities = detect.body_then_channels(body, hidden, ["project_id"])
    entities = cut(entities)
    decisions = decisions if decisions is not None else no_decisions(texts.sparkSession)
    items = cut(mapping.build_mapping(entities, decisions))
    return Redaction(entities, items, redact.redact(texts, items, "project_id", key, "text"), present)


def public_package(r: Redaction, key: str, files: DataFrame | None = None, decisions: DataFrame | None = None, channels: DataFrame | None = None) -> DataFrame:
    """(project_id, schema_version, ...): one nested row for each project, without originals; blocks stay in their own frame.

    ``channels`` (project_id, file_ord, status, reason, kind, count) add a hidden report and its warning."""
    decisions = decisions if decisions is not None else no_decisions(r.items.sparkSession)
    needles = audit.residual_needles(r.items, audit.kept_values(r.entities, decisions), r.present)
    residual = audit.scan_residuals(r.blocks.select("project_id", "text"), needles)
    impact = audit.impact_summary(audit.impact_items(r.entities, r.items, decisions))
    stats = mapping.mapping_stats(r.items).groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("field_stats"))
    x = r.blocks.groupBy("project_id").agg(F.count("*").alias("block_count"))
    for part in (residual.select("project_id", F.struct("checked", "hits", "status").alias("residual_scan")), impact.select("project_id", F.struct(*[c for c in impact.columns if c != "project_id"]).alias("impact")), stats, audit.analysis_flags(r.blocks.select("project_id", "text"), r.items).select("project_id", F.struct("trl_factors_preserved", "benefit_factors_preserved", "stable_placeholders_used").alias("flags")), audit.structured_facts(r.items).select("project_id", F.struct("amount_ranges", "patent_count").alias("facts"))):
        x = x.join(part, "project_id", "left")
    gate = F.col("impact.overall_level")
    if files is not None:
        w = audit.review_warnings(r.blocks.select("project_id", "text"), r.items, files)
        x = x.join(w.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "warning"))), lambda y: y["warning"]).alias("warnings")), "project_id", "left")
    else:
        x = x.withColumn("warnings", F.array(F.lit(FINAL_WARNING)))
    hidden = F.lit(None).cast("string")
    if channels is not None:
        counts = channels.filter("kind is not null").select("project_id", "kind", "count")
        report = audit.hidden_channel_report(channels.select("project_id", "file_ord", "status").distinct(), counts)
        x = x.join(report.select("project_id", F.struct("overall_status", "file_count", "channel_counts").alias("hidden_report")), "project_id", "left")
        hidden = audit.hidden_warning(F.col("hidden_report.overall_status"))
    more = F.array_compact(F.array(audit.residual_warning(F.col("residual_scan.status"), F.col("residual_scan.hits")), hidden))
    return x.withColumn("warnings", F.concat(more, F.coalesce("warnings", F.array(F.lit(FINAL_WARNING))))).withColumn("gate_message", audit.gate_message(gate)).withColumn("schema_version", F.lit(SCHEMA))


def write_package(r: Redaction, package: DataFrame, out: str, decisions: DataFrame | None = None) -> None:
    """Writes public frames first and the private mapping last, so a failure leaves no mapping behind."""
    package.write.mode("overwrite").partitionBy("project_id").json(f"{out}/packages")
    r.blocks.write.mode("overwrite").partitionBy("project_id").json(f"{out}/blocks")
    review.review_candidates(r.items, audit.impact_items(r.entities, r.items, decisions if decisions is not None else no_decisions(r.items.sparkSession))).write.mode("overwrite").partitionBy("project_id").json(f"{out}/candidates")
    r.items.write.mode("overwrite").partitionBy("project_id").json(f"{out}/mapping.private")
