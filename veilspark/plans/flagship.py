"""The flagship: documents of all projects detected, mapped and redacted in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.operators.package import public_package, redact_projects
from veilspark.session import load, spread


def _redaction(spark: SparkSession, sf_dir: str):
    t = load(spark, sf_dir, "documents").filter("project_id is not null and text is not null").select("project_id", "doc_id", "text")
    return redact_projects(spread(t), "doc_id", load(spark, sf_dir, "decisions"), load(spark, sf_dir, "dictionary"))


def flagship_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project document, redacted with the mapping of its project."""
    return _redaction(spark, sf_dir).blocks


def project_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public package of every project."""
    r = _redaction(spark, sf_dir)
    p = public_package(r, "doc_id", None, load(spark, sf_dir, "decisions"))
    return p.selectExpr("project_id", "schema_version", "block_count", "residual_scan.checked", "residual_scan.hits", "residual_scan.status", "impact.overall_level", "flags.benefit_factors_preserved", "facts.patent_count", "cardinality(field_stats) as kinds")


QUERIES = {"flagship_redaction": flagship_redaction, "project_packages": project_packages}
SQL: dict[str, str] = {}
