"""What is handed over: review workspaces, restored reports, validated external copies of text and office files, summaries, and checks of a runtime.

Files are staged and renamed, so a reader sees a whole delivery or none. Anything unexpected blocks a file with a fixed reason code."""

from __future__ import annotations

import hashlib
import html
import importlib.util
import json
import os
import re
import shutil
import sys
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.detect import detect
from veilspark.operators.redact import Replacer
from veilspark.operators.release import OFFICE_TYPES, TEXT_TYPES
from veilspark.operators.rules import STRATEGIES
from veilspark.sources import formats, office

DECISION_VALUES = ["redact|pseudonym", "redact|mask", "redact|range", "keep|keep"]
JOB_LABELS = {"queued": "排队中", "running": "处理中", "completed": "已完成", "failed": "失败", "cancelled": "已取消"}
_DANGEROUS = ("/", "/bin", "/boot", "/dev", "/etc", "/lib", "/proc", "/root", "/sbin", "/sys", "/usr", "/var")


def decision_value(action: Column, strategy: Column) -> Column:
    """The value of a decision's choice in a review form; unknown ones fall back to a pseudonym."""
    v = F.when(action == "keep", "keep|keep").otherwise(F.concat(F.lit("redact|"), F.coalesce(strategy, F.lit("pseudonym"))))
    return F.when(v.isin(*DECISION_VALUES), v).otherwise(DECISION_VALUES[0])


def default_decisions(candidates: list[dict]) -> str:
    """A JSON file of decisions that changes nothing, for editing."""
    out = {c["candidate_id"]: {"action": "keep" if c["strategy"] == "keep" else "redact", "strategy": c["strategy"] if c["strategy"] in STRATEGIES else None} for c in candidates}
    return json.dumps(out, ensure_ascii=False, indent=2)


def review_page(project: str, candidates: list[dict], preview: str) -> str:
    """The page on which a customer decides about each candidate; every value is escaped."""
    e = lambda x: html.escape(str(x if x is not None else ""))

    def choices(c: dict) -> str:
        now = "keep|keep" if c["strategy"] == "keep" else f"redact|{c['strategy']}"
        return "".join(f'<option value="{v}"{" selected" if v == now else ""}>{v}</option>' for v in DECISION_VALUES)

    rows = "".join(f'<tr data-id="{e(c["candidate_id"])}"><td>{e(c["kind"])}</td><td>{e(c["placeholder"])}</td><td>{e(c["preservation_value"])}</td><td>{e(c["impact_level"])}</td><td><select>{choices(c)}</select></td></tr>' for c in candidates)
    return f'<!doctype html><meta charset="utf-8"><title>{e(project)}</title><h1>{e(project)}</h1><table><tr><th>kind</th><th>placeholder</th><th>preserved</th><th>impact</th><th>decision</th></tr>{rows}</table><pre>{e(preview)}</pre>'


def export_workspace(folder: str, project: str, candidates: list[dict], preview: str, report: str) -> dict[str, str]:
    """Candidates, preview, report, page and default decisions of one project."""
    os.makedirs(folder, exist_ok=True)
    files = {"review_candidates.json": json.dumps({"project_id": project, "items": candidates}, ensure_ascii=False, indent=2), "restore_preview.json": json.dumps({"preview": preview}, ensure_ascii=False, indent=2), "review_report.md": report, "review_workspace.html": review_page(project, candidates, preview), "default_decisions.json": default_decisions(candidates)}
    for name, text in files.items():
        _replace(os.path.join(folder, name), text.encode("utf-8"))
    return {name: os.path.join(folder, name) for name in files}


def report_delivery(evaluation: dict, items: list[dict], preview: str, folder: str) -> dict:
    """The report of an evaluation with its placeholders put back for the customer, and a manifest of what was written."""
    back = Replacer([(i["replacement"], i["original"]) for i in items if i["replacement"] != i["placeholder"]] + [(i["placeholder"], i["original"]) for i in items])
    advice = evaluation.get("recommendations") or []
    lines = [f"# {evaluation.get('title') or 'Evaluation'}", "", evaluation.get("summary") or "", "", "## Recommendations", "", *[f"- {a}" for a in ([advice] if isinstance(advice, str) else advice)], "", "## Source", "", preview[:600]]
    redacted = "\n".join(lines) + "\n"
    os.makedirs(folder, exist_ok=True)
    out = {}
    for name, text in (("report.redacted.md", redacted), ("report.restored.private.md", back(redacted))):
        _replace(os.path.join(folder, name), text.encode("utf-8"))
        out[name] = hashlib.sha256(text.encode("utf-8")).hexdigest()
    _replace(os.path.join(folder, "delivery_manifest.json"), json.dumps({"files": out}, indent=2).encode())
    return out


def _replace(path: str, data: bytes) -> None:
    part = f"{path}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def package_reason(package: dict, sources: int) -> str:
    """The reason that blocks a whole release, or ''; ``release.package_gate`` for one package at hand."""
    residual = package.get("residual_scan") or {}
    expected = package.get("mapping_hash")
    if residual.get("status") != "clear" or type(residual.get("hits")) is not int or residual["hits"]:
        return "residual_not_clear"
    if package.get("sources") != sources:
        return "source_evidence_missing"
    if not isinstance(expected, str) or not re.fullmatch("[0-9a-f]{64}", expected) or expected != package.get("actual_mapping_hash"):
        return "mapping_hash_mismatch"
    return ""


class _Blocked(Exception):
    """A file that is not released, with its reason."""


def release_copy(name: str, data: bytes, pairs: list[tuple[str, str]]) -> bytes:
    """A copy of a text or office file with everything replaced, read again and searched for what should be gone."""
    kind, needles = formats.suffix(name), [o for o, _ in pairs if o]
    if formats.parse(name, data)[1] != "ok":
        raise _Blocked("source_parse_not_ok")
    if formats.inspect(name, data)[0] not in ("clear", "found"):
        raise _Blocked("hidden_channels_unverified")
    if kind in OFFICE_TYPES:
        try:
            return office.release_copy(data, kind == "docx", pairs, needles)
        except office.Unreadable as e:
            raise _Blocked(str(e)) from None
        except Exception:
            raise _Blocked("rewrite_or_validation_failed") from None
    if kind not in TEXT_TYPES:
        raise _Blocked("unsupported")
    try:
        new = Replacer(pairs)(data.decode("utf-8"))
    except UnicodeDecodeError:
        raise _Blocked("source_parse_unverified") from None
    if not new.strip():
        raise _Blocked("output_missing_or_empty")
    if any(o in new for o in needles):
        raise _Blocked("residual_after_rewrite")
    return new.encode("utf-8")


def _released(f: dict, pairs: list[tuple[str, str]], blocked: str, drift: set[str]) -> bytes:
    name, data = f["file_name"], f["content"]
    blocks, status, _ = formats.parse(name, data) if drift else ([], "", [])
    texts = [b["text"] for b in blocks] + (formats.channel_texts(name, data) if status == "ok" else [])
    for bad, reason in (
        (formats.suffix(name) == "pdf", "pdf_external_release_disabled"),
        (f.get("reason"), f.get("reason")),
        (blocked, blocked),
        (hashlib.sha256(data).hexdigest() != f["file_hash"], "source_hash_mismatch"),
        (any("ocr_low_confidence" in w for w in f.get("warnings") or []), "source_parse_unverified"),
        (any(v in t for v in drift for t in texts), "channel_mapping_drift"),
    ):
        if bad:
            raise _Blocked(reason)
    return release_copy(name, data, pairs)


def export_release(files: list[dict], pairs: list[tuple[str, str]], folder: str, package: dict, drift: set[str] | None = None) -> dict:
    """Validated copies of ``files`` (file_name, content, file_hash, reason, warnings), published in one rename.

    ``package`` (residual_scan, sources, mapping_hash, actual_mapping_hash) must pass its gate, else every file is blocked; ``drift`` holds
    values that a second look at the sources finds and the mapping lacks (``channel_drift``), and blocks the files that hold one. A file
    that a gate has blocked keeps its reason; names of copies are aliases, as a name may be private."""
    batch, blocked = uuid.uuid4().hex, package_reason(package, len(files))
    staging, target = Path(folder) / f".{batch}.part", Path(folder) / batch
    staging.mkdir(parents=True)
    rows = []
    try:
        for i, f in enumerate(files, 1):
            name = f"file_{i:04d}.{formats.suffix(f['file_name'])}"
            row = {"source_index": i - 1, "status": "blocked", "reason": "", "output_name": "", "sha256": "", "source_sha256": ""}
            try:
                copy = _released(f, pairs, blocked, drift or set())
                (staging / name).write_bytes(copy)
                row |= {"status": "exported", "output_name": name, "sha256": hashlib.sha256(copy).hexdigest(), "source_sha256": f["file_hash"]}
            except _Blocked as e:
                row["reason"] = str(e)
            except Exception:
                row["reason"] = "source_unverified"
            rows.append(row)
        names = {r["output_name"] for r in rows if r["output_name"]}
        if {p.name for p in staging.iterdir()} != names:
            raise RuntimeError("unexpected_batch_file")
        if any(hashlib.sha256((staging / r["output_name"]).read_bytes()).hexdigest() != r["sha256"] for r in rows if r["output_name"]):
            raise RuntimeError("output_changed_after_validation")
        manifest = {"schema_version": "external_release.v1", "batch_id": batch, "direct_release_claim": False, "files": rows, "exported_count": len(names), "blocked_count": len(rows) - len(names)}
        (staging / "manifest.json").write_text(json.dumps(manifest, indent=2))
        staging.rename(target)
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    return manifest


def channel_drift(entities: DataFrame, items: DataFrame) -> DataFrame:
    """(project_id, original) of values that a second look at the sources finds and the mapping lacks: they block a release."""
    return entities.select("project_id", "original").filter("original <> ''").distinct().join(items.select("project_id", "original"), ["project_id", "original"], "left_anti")


def release_summary(packages: DataFrame) -> DataFrame:
    """The counters of packages that support may see."""
    return packages.selectExpr("project_id", "coalesce(residual_scan.status, '') as residual_status", "coalesce(residual_scan.hits, 0) as residual_hit_count", "coalesce(impact.overall_level, '') as overall_level")


def job_summary(job: dict) -> dict[str, str]:
    """A job in words, without paths of inputs."""
    p = job.get("progress") or {}
    return {"status": JOB_LABELS.get(job.get("status", ""), job.get("status") or "未知"), "progress": f"{p.get('current') or 0}/{p.get('total') or 0}", "error": job.get("error") or "无"}


def next_actions(counts: dict[str, int]) -> list[str]:
    """What a user should do about the classes of an input plan."""
    out = [code for key, code in (("processable", "start_processing"), ("convertible", "conversion_will_be_tried"), ("unsupported", "convert_to_supported_format"), ("missing", "check_paths")) if counts.get(key)]
    return out or ["select_other_inputs"]


def safe_path(path: str, roots: list[str] | None = None) -> bool:
    """Whether a path may be read or written: absolute, no system folder, no way up, and below one of ``roots`` if any are given."""
    if not path or not os.path.isabs(path) or ".." in Path(path).parts:
        return False
    real = os.path.realpath(path)
    if real in _DANGEROUS or any(real == d or real.startswith(d + "/") for d in _DANGEROUS if d not in ("/", "/root", "/var")):
        return False
    return not roots or any(real == os.path.realpath(r) or real.startswith(os.path.realpath(r) + "/") for r in roots)


def runtime_preflight(spark: SparkSession, folder: str) -> list[dict]:
    """Whether the runtime can do its work: versions, a writable folder, optional libraries, a Spark job."""
    checks = [{"check": "python", "ok": sys.version_info >= (3, 10)}]
    try:
        probe = Path(folder) / f".probe-{uuid.uuid4().hex}"
        probe.write_text("x")
        probe.unlink()
        checks.append({"check": "writable", "ok": True})
    except OSError:
        checks.append({"check": "writable", "ok": False})
    checks += [{"check": f"library:{n}", "ok": importlib.util.find_spec(n) is not None} for n in ("pandas", "pyarrow", "ahocorasick")]
    checks.append({"check": "spark", "ok": spark.range(3).count() == 3})
    return checks


def acceptance(spark: SparkSession) -> list[dict]:
    """A small project through detection and redaction; each check says what must hold."""
    text = "项目名称：示范工程，联系人：王小明。电话：13812345678，计 350万元，额定 5kV。"
    df = spark.createDataFrame([("p", 1, text)], "project_id string, n int, text string")
    from veilspark.operators.package import redact_projects

    r = redact_projects(df, "n")
    new = r.blocks.first()["text"]
    kinds = {x["kind"] for x in detect(df, ["project_id"], "n", "text").collect()}
    return [{"check": "detects", "ok": {"project_name", "person", "phone", "amount", "technical_metric"} <= kinds}, {"check": "hides", "ok": not re.search("示范工程|王小明|13812345678|350万元", new)}, {"check": "keeps_metrics", "ok": "5kV" in new}, {"check": "keeps_ranges", "ok": "100万至500万" in new}]
