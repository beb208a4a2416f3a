"""Checks around the engine: rule updates, secrets in texts and configurations, issue ledgers, support bundles, bundle manifests.

Defined results: nulls count as missing; a secret is reported by line, never by value."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that hold a key or a password, and names of files that must not be published (fixed values).
SECRET_PATTERNS = [r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"(?i)(api[_-]?key|secret|smtp[_-]?password)\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{12,}"]
NAME_PATTERNS = [
    r"(?i)(^|[/\\])\.release", r"(?i)local_mapping\.private", r"(?i)trial_usage_.*\.json$", r"(?i)registration_request\.json$", r"(?i)registration_mailto\.txt$",
    r"(?i)(^|[/\\])license\.json$", r"(?i)private[_-]?key", r"(?i)secret", r"(?i)\.env$", r"(?i)\.(pem|key)$",
]
GUARDRAILS = ["本地映射表不得上传", "金额字段不默认清空", "技术指标和验证阶段默认保留"]
RULES_SCHEMA = "document_redaction_rules_manifest.v1"


def has_secret(line: Column) -> Column:
    return line.rlike("|".join(f"(?:{p})" for p in SECRET_PATTERNS))


def secret_scan(df: DataFrame, key: str, text: str, allowed: list[str] | None = None) -> DataFrame:
    """(key, line): the numbers of lines that look like a key or a password, apart from the expressions that are ``allowed`` in them."""
    x = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\r\n|\r|\n")).alias("pos", "l"))
    line = F.col("l")
    for a in allowed or []:
        line = F.replace(line, F.lit(a), F.lit(""))
    return x.filter(has_secret(line)).select(key, (F.col("pos") + 1).alias("line"))


def blocked_names(df: DataFrame, path: str) -> DataFrame:
    """Paths that must not be published."""
    return df.filter(F.col(path).rlike("|".join(f"(?:{p})" for p in NAME_PATTERNS))).select(path).distinct()


def rules_update(updates: DataFrame) -> DataFrame:
    """Adds status and message to rows of (schema_version, version, guardrails, field_groups array<struct<name, default_action>>)."""
    missing = F.array_except(F.array(*[F.lit(g) for g in GUARDRAILS]), F.coalesce("guardrails", F.array().cast("array<string>")))
    groups = F.coalesce(F.col("field_groups"), F.array().cast("array<struct<name:string,default_action:string>>"))
    action = lambda g: F.coalesce(g["default_action"], F.lit(""))
    metric = F.exists(groups, lambda g: (g["name"] == "technical_metric") & (action(g) != "keep"))
    amount = F.exists(groups, lambda g: (g["name"] == "amount") & ~action(g).isin("range", "keep"))
    code = (
        F.when(F.coalesce("schema_version", F.lit("")) != RULES_SCHEMA, "invalid:schema_version")
        .when(F.size(missing) > 0, F.concat(F.lit("blocked:guardrails:"), F.array_join(missing, ";")))
        .when(metric, "blocked:technical_metric")
        .when(amount, "blocked:amount")
        .otherwise("valid:")
    )
    return updates.withColumn("status", F.substring_index(code, ":", 1)).withColumn("message", F.regexp_replace(code, "^[a-z]+:", ""))


def default_rules() -> dict:
    """The manifest of the rules that are built in."""
    from veilspark.operators.rules import RULES

    groups = {}
    for r in RULES:
        groups.setdefault(r.kind, {"name": r.kind, "default_action": r.strategy, "placeholder_prefix": r.prefix})
    return {"schema_version": RULES_SCHEMA, "version": "1", "guardrails": GUARDRAILS, "field_groups": list(groups.values())}


def config_issues(config: dict) -> list[str]:
    """Paths of a nested configuration whose values look like secrets, or whose mandatory values are missing."""
    out = [f"missing:{k}" for k in ("endpoint", "project_alias_id") if not config.get(k)]

    def walk(x, path):
        if isinstance(x, dict):
            for k, v in x.items():
                walk(v, f"{path}.{k}" if path else str(k))
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(v, f"{path}[{i}]")
        elif isinstance(x, str) and x and re.search(r"(?i)(secret|token|password|api[_-]?key|private[_-]?key)", path) and not x.startswith("${"):
            out.append(f"secret:{path}")

    walk(config, "")
    return out


def ledger(issues: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Issues reduced to the ledger's columns, blank ones filled with defaults."""
    return issues.select(*[F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(d)).alias(c) for c, d in defaults.items()])


def support_bundle(jobs: DataFrame) -> DataFrame:
    """Counts and statuses only; an error is reduced to the name of its type."""
    return jobs.select("job_id", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce(F.nullif(F.regexp_extract("error", r"^([A-Za-z_]*(?:Error|Exception|Cancelled))", 1), F.lit("")), F.when(F.coalesce("error", F.lit("")) != "", "Error"), F.lit("")).alias("error_type"), F.size(F.coalesce("files", F.array().cast("array<string>"))).alias("file_count"))


def verify_bundle(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status) of the files that a manifest (path, size, sha256) names, against those that are there (path, size, sha256)."""
    f = files.select("path", F.col("size").alias("has_size"), F.col("sha256").alias("has_sha"))
    status = F.when(F.col("has_sha").isNull(), "missing").when(F.col("has_size") != F.col("size"), "size_mismatch").when(F.col("has_sha") != F.col("sha256"), "sha256_mismatch").otherwise("ok")
    return manifest.join(f, "path", "left").select("path", status.alias("status"))


def sign(secret: str, timestamp: str, body: bytes) -> str:
    return hmac.new(secret.encode(), timestamp.encode() + b"." + body, hashlib.sha256).hexdigest()


def verify_signature(secret: str, timestamp: str, body: bytes, signature: str, now: float | None = None, skew: int = 300) -> bool:
    """Whether a request was signed with the secret, no longer than ``skew`` seconds ago or ahead."""
    try:
        fresh = abs((time.time() if now is None else now) - float(timestamp)) <= skew
    except (TypeError, ValueError):
        return False
    return fresh and hmac.compare_digest(sign(secret, timestamp, body), signature or "")


def fingerprint(report: dict) -> str:
    return hashlib.sha256(json.dumps(report, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
