"""Planning of inputs and reading quality: what can be processed, converted or only skipped, and whether a text was read well.

Defined results: a null path has no suffix and is skipped; null statuses and warnings count as absent; files delivered twice count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import two_decimals

PROCESSABLE = [".docx", ".xlsx", ".pdf", ".txt", ".md"]
CONVERTIBLE = [".doc", ".xls", ".wps"]
SKIPPED = [".zip", ".rar", ".7z", ".db", ".json", ".jpg", ".jpeg", ".png"]


def suffix(path: Column) -> Column:
    """The lower-case suffix of a path's last part, or nothing."""
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"[^/\\](\.[^./\\]+)$", 1))


def classify(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(*PROCESSABLE), "processable").when(s.isin(*CONVERTIBLE), "convertible").when(s.isin(*SKIPPED) | (s == ""), "skipped").otherwise("unsupported")


def target_extension(path: Column) -> Column:
    s = suffix(path)
    return F.when(s == ".xls", ".xlsx").when(s.isin(*CONVERTIBLE), ".docx")


def input_plan(files: DataFrame, path: str) -> DataFrame:
    """(path, extension, input_class, reason, target_extension) of each distinct path."""
    p = F.col(path)
    c = classify(p)
    reason = F.when(c == "convertible", "office_conversion_required").when(c == "skipped", "not_document_input").when(c == "unsupported", "unsupported_format").otherwise("")
    return files.select(path).distinct().select(p.alias("path"), F.when(suffix(p) == "", "(none)").otherwise(suffix(p)).alias("extension"), c.alias("input_class"), reason.alias("reason"), F.coalesce(target_extension(p), F.lit("")).alias("target_extension"))


def plan_status(plan: DataFrame) -> DataFrame:
    """One row: the counts by class and the status of the plan."""
    n = {c: F.count_if(F.col("input_class") == c).alias(c) for c in ("processable", "convertible", "unsupported", "skipped")}
    x = plan.agg(*n.values())
    status = F.when((F.col("processable") == 0) & (F.col("convertible") == 0), "blocked_no_inputs").when(F.col("convertible") + F.col("unsupported") + F.col("skipped") > 0, "ready_with_warnings").otherwise("ready")
    return x.withColumn("status", status)


def conversion_report(plan: DataFrame, converter: bool = False) -> DataFrame:
    """(path, target_extension, status) of the files to convert; without a converter each one fails, with its reason."""
    return plan.filter("input_class = 'convertible'").select("path", "target_extension", F.lit("pending" if converter else "office_converter_not_found").alias("status"))


def ocr_pages(mode: Column, default: int = 5) -> Column:
    """Pages to read in a mode; the full mode follows the environment's default."""
    m = F.lower(F.trim(F.coalesce(mode, F.lit("quick"))))
    return F.when(m.isin("full", "complete"), default).otherwise(1)


def ocr_warnings(status: Column, confidence: Column, threshold: float = 0.5) -> Column:
    """The warnings that reading by recognition adds to a file."""
    low = F.when(confidence < threshold, F.concat(F.lit("ocr_low_confidence:"), two_decimals(confidence)))
    return F.when(status == "ok", F.array_compact(F.array(F.lit("ocr_applied"), low))).otherwise(F.array().cast("array<string>"))


def merge_pages(pages: DataFrame, key: str) -> DataFrame:
    """(key, text, confidence, status): non-empty page texts in order, mean of the confidences above nought."""
    t = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("page", "text")))), lambda x: x["text"]), "\n")
    x = pages.groupBy(key).agg(t.alias("text"), F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("confidence"))
    return x.withColumn("status", F.when(F.col("text") == "", "empty").otherwise("ok"))


def quality_gate(status: Column, file_type: Column, warnings: Column, text_length: Column) -> Column:
    """blocked, warning or ok, for a file and the text that was read from it."""
    blocked = (F.coalesce(status, F.lit("")) == "ocr_required") | F.coalesce(F.array_contains(warnings, "ocr_required"), F.lit(False))
    return F.when(blocked, "blocked").when((F.coalesce(text_length, F.lit(0)) < 20) & (F.lower(F.coalesce(file_type, F.lit(""))) == "pdf"), "warning").otherwise("ok")
