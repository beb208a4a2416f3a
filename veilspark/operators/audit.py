"""Audits of a redaction: residuals, impact, flags, facts, warnings and hidden channels.

Defined results: a project without items has nothing to check and is clear; null texts hold no residuals; unknown kinds have the default
profile; repeated rows count once. A clear scan is a scan result, never a proof that nothing sensitive is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.detect import technical_signal
from veilspark.operators.mapping import decided, normalize_decisions
from veilspark.operators.redact import present_values
from veilspark.operators.rules import IMPACT, LEVELS, SOFTENED


def kept_values(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """(project_id, original) of values that stay by decision or by default."""
    return decided(entities, decisions).filter("kept").select("project_id", "original").distinct()


def residual_needles(items: DataFrame, kept: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(project_id, needle, source): the originals that must not be left, each once, those of the mapping before those of a dictionary."""
    m = items.filter("original <> '' and not (kind = 'technical_metric' and strategy = 'keep')").select("project_id", F.col("original").alias("needle"), F.lit("mapping").alias("source"))
    if extra is not None:
        m = m.unionByName(extra.select("project_id", F.col("value").alias("needle"), F.lit("dictionary").alias("source")))
    one = m.groupBy("project_id", "needle").agg(F.max("source").alias("source"))
    return one.join(kept.withColumnRenamed("original", "needle"), ["project_id", "needle"], "left_anti")


def scan_residuals(redacted: DataFrame, needles: DataFrame) -> DataFrame:
    """(project_id, checked, hits, status): needles, not occurrences, that stand in any text of the project."""
    hit = present_values(redacted, needles.select("project_id", "needle"), "project_id", "text", "needle").withColumn("hit", F.lit(1))
    x = needles.join(hit, ["project_id", "needle"], "left").groupBy("project_id").agg(F.count("*").alias("checked"), F.count("hit").alias("hits"))
    x = redacted.select("project_id").distinct().join(x, "project_id", "left")
    return x.select("project_id", F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.coalesce("hits", F.lit(0)) > 0, "residual_found").otherwise("clear").alias("status"))


def residual_warning(status: Column, hits: Column) -> Column:
    return F.when(status.isNull() | (status == "not_scanned"), "residual_not_scanned").when(status == "residual_found", F.concat(F.lit("residual_found:"), hits.cast("string")))


def _lookup(kind: Column, i: int, default: str) -> Column:
    c = F.lit(default)
    for k, profile in IMPACT.items():
        c = F.when(kind == k, profile[i]).otherwise(c)
    return c


def impact_domain(kind: Column) -> Column:
    return _lookup(kind, 0, "other")


def base_level(kind: Column) -> Column:
    return _lookup(kind, 1, "low")


def effective_level(kind: Column, strategy: Column, level: Column) -> Column:
    return F.when(level == "none", "none").when((kind == "amount") & (strategy == "range"), "low").when(kind.isin(*SOFTENED) & (strategy == "pseudonym"), "low").otherwise(level)


def score(level: Column) -> Column:
    c = F.lit(1)
    for i, x in enumerate(LEVELS):
        c = F.when(level == x, i).otherwise(c)
    return c


def impact_items(entities: DataFrame, items: DataFrame, decisions: DataFrame) -> DataFrame:
    """(project_id, candidate_id, kind, action, strategy, impact_domain, impact_level) of every entity."""
    e = decided(entities, decisions).groupBy("project_id", "candidate_id", "kind").agg(F.min(F.struct("ord", "strategy", "d_strategy")).alias("e"))
    m = items.groupBy("project_id", "candidate_id").agg(F.max("strategy").alias("m_strategy"), F.lit(True).alias("mapped"))
    x = e.join(m, ["project_id", "candidate_id"], "left")
    redacted = F.coalesce("mapped", F.lit(False))
    strategy = F.when(redacted, F.col("m_strategy")).otherwise(F.coalesce("e.d_strategy", "e.strategy"))
    level = F.when(redacted, base_level(F.col("kind"))).otherwise("none")
    return x.select("project_id", "candidate_id", "kind", F.when(redacted, "redact").otherwise("keep").alias("action"), strategy.alias("strategy"), impact_domain(F.col("kind")).alias("impact_domain"), effective_level(F.col("kind"), strategy, level).alias("impact_level"))


def impact_summary(impacts: DataFrame) -> DataFrame:
    """One row for each project: the gate, the level of each domain and the lists of fields."""
    red, level = F.col("action") == "redact", F.col("impact_level")
    domain = lambda d: F.coalesce(F.max_by(level, F.when(red & (F.col("impact_domain") == d), score(level))), F.lit("none")).alias(f"{d}_impact")
    fields = lambda cond, name: F.array_join(F.sort_array(F.collect_set(F.when(cond, F.col("kind")))), ",").alias(name)
    x = impacts.groupBy("project_id").agg(
        F.bool_or(red & (level == "high")).alias("blocked"), F.coalesce(F.max(F.when(red, score(level))), F.lit(0)).alias("top"),
        F.bool_or(~red & (F.col("impact_domain") == "privacy")).alias("private_kept"), *[domain(d) for d in ("trl", "benefit", "evidence", "transfer_readiness")],
        fields(red & (F.col("strategy") == "mask"), "strongly_redacted_fields"), fields(red & level.isin("medium", "high"), "redacted_assessment_fields"),
        fields(~red, "preserved_assessment_factors"), fields(~red & (F.col("impact_domain") == "privacy"), "kept_sensitive_fields"),
    )
    overall = F.when(F.col("blocked"), "blocked_requires_confirmation").when((F.col("top") >= 2) | F.col("private_kept"), "warning").otherwise("pass")
    return x.select("project_id", overall.alias("overall_level"), *[c for c in x.columns if c not in ("project_id", "blocked", "top", "private_kept")])


def gate_message(overall: Column) -> Column:
    """What the gate of an impact summary asks for."""
    return (
        F.when(overall == "blocked_requires_confirmation", "high impact fields are redacted: confirm before the assessment")
        .when(overall == "warning", "assessment fields are redacted or personal values are kept: review before use")
        .when(overall == "pass", "no assessment field is affected")
        .otherwise("no impact summary: review before use")
    )


def unmatched_decisions(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """(project_id, candidate_id) of decisions that belong to no entity of their project."""
    ids = decided(entities, decisions).select("project_id", "candidate_id").distinct()
    return normalize_decisions(decisions).select("project_id", "candidate_id").join(ids, ["project_id", "candidate_id"], "left_anti")


def analysis_flags(redacted: DataFrame, items: DataFrame) -> DataFrame:
    """(project_id, trl_factors_preserved, benefit_factors_preserved, stable_placeholders_used)."""
    t = redacted.groupBy("project_id").agg(F.bool_or(technical_signal(F.col("text"))).alias("trl_factors_preserved"))
    m = items.groupBy("project_id").agg(F.bool_or((F.col("kind") == "amount") & (F.coalesce("preservation_value", F.lit("")) != "")).alias("benefit"), F.lit(True).alias("used"))
    return t.join(m, "project_id", "left").select("project_id", "trl_factors_preserved", F.coalesce("benefit", F.lit(False)).alias("benefit_factors_preserved"), F.coalesce("used", F.lit(False)).alias("stable_placeholders_used"))


def structured_facts(items: DataFrame) -> DataFrame:
    """(project_id, amount_ranges, patent_count); the ranges in the order of the mapping, as placeholder=range."""
    i = items.dropDuplicates(["project_id", "candidate_id"])
    one = F.when(F.col("kind") == "amount", F.struct("ord", "candidate_id", F.concat("placeholder", F.lit("="), F.coalesce("preservation_value", F.lit(""))).alias("v")))
    return i.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["v"]), ";").alias("amount_ranges"), F.count_if(F.col("kind") == "patent_id").alias("patent_count"))


def review_warnings(redacted: DataFrame, items: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, pos, warning) in order: signal, amounts, files that failed, files read with low confidence, the constant last one."""
    flags = analysis_flags(redacted, items)
    amounts = items.filter("kind = 'amount'").groupBy("project_id").agg(F.count("*").alias("amounts"))
    f = files.dropDuplicates(["project_id", "file_ord"]).groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.when(F.coalesce("parser_status", F.lit("")) != "ok", F.struct("file_ord", "file_name")))).alias("failed"),
        F.array_sort(F.collect_list(F.when(F.exists("warnings", lambda w: w.contains("ocr_low_confidence")), F.struct("file_ord", "file_name")))).alias("low"),
    )
    x = flags.join(amounts, "project_id", "left").join(f, "project_id", "left")
    names = lambda c: F.array_join(F.transform(c, lambda y: y["file_name"]), "、")
    listed = lambda c, code: F.when(F.size(c) > 0, F.concat(F.lit(f"{code}:"), names(c)))
    all_ = F.array(
        F.when(~F.col("trl_factors_preserved"), "no_technical_signal"),
        F.when(F.coalesce("amounts", F.lit(0)) == 0, "no_amounts").when(~F.col("benefit_factors_preserved"), "amounts_without_range"),
        listed(F.col("failed"), "files_failed"), listed(F.col("low"), "ocr_low_confidence"), F.lit("not_for_direct_release"),
    )
    return x.select("project_id", F.posexplode(F.array_compact(all_)).alias("pos", "warning"))


def hidden_channel_report(files: DataFrame, channels: DataFrame) -> DataFrame:
    """(project_id, overall_status, file_count) from per-file statuses: found before unverified before clear."""
    s = files.groupBy("project_id").agg(F.count("*").alias("file_count"), F.bool_or(F.col("status") == "found").alias("f"), F.bool_or(F.col("status").isin("unverified", "conversion_required", "unsupported")).alias("u"))
    n = channels.groupBy("project_id", "kind").agg(F.sum("count").alias("n")).groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("channel_counts"))
    return s.join(n, "project_id", "left").select("project_id", F.when(F.col("f"), "found").when(F.col("u"), "unverified").otherwise("clear").alias("overall_status"), "file_count", "channel_counts")


def hidden_warning(status: Column) -> Column:
    return F.when(status == "found", "hidden_channels_found").when(status == "unverified", "hidden_channels_unverified")
