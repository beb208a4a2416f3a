"""Folders of files as DataFrames: one pass over the bytes gives manifest, blocks, channel texts and channel inventory.

Defined results: a file that cannot be read is a row with its status, never a failed job; the project is the folder above the file; files
and blocks are numbered in the order of their names and contents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.numbering import number_within
from veilspark.sources import formats

STRUCTURE = "struct<kind:string,sheet:int,row:string,cells:array<struct<ref:string,text:string>>,engine:string,confidence:double,pages_processed:int>"
_FILE = f"path string, file_name string, file_type string, file_hash string, parser_status string, warnings array<string>, blocks array<struct<block_ord:int,location:string,text:string,structure:{STRUCTURE}>>, channel_texts array<string>, channel_status string, channel_reason string, channels map<string,int>"

#: An engine takes (name, bytes, pages) and returns status, engine, text and confidence.
OcrEngine = Callable[[str, bytes, int], dict]


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, length) of all files below a folder; their contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return f.select("path", "length")


def read_files(spark: SparkSession, root: str, ocr: OcrEngine | None = None, ocr_pages: int = 5, low_confidence: float = 0.5) -> DataFrame:
    """One row for each file below a folder, with everything that is read from it; see ``manifest``, ``blocks``, ``channel_texts``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content", F.sha2("content", 256).alias("file_hash"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([_one(p, c, h, ocr, ocr_pages, low_confidence) for p, c, h in zip(pdf["path"], pdf["content"], pdf["file_hash"])])

    x = f.mapInPandas(read, _FILE)
    project = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return number_within(x.withColumn("project_id", project), ["project_id"], ["path"], "file_ord")


def _one(path: str, data: bytes, digest: str, ocr: OcrEngine | None, pages: int, low: float) -> dict:
    name = path.rsplit("/", 1)[-1]
    found, status, warnings = formats.parse(name, data)
    if status == "ocr_required" and ocr is not None:
        found, status, warnings = _recognise(name, data, ocr, pages, low)
    try:
        texts = formats.channel_texts(name, data)
    except Exception:
        texts = []
    state, reason, counts = formats.inspect(name, data)
    blank = {"kind": None, "sheet": None, "row": None, "cells": None, "engine": None, "confidence": None, "pages_processed": None}
    rows = [{"block_ord": i, "location": b["location"], "text": b["text"], "structure": (blank | b["structure"]) if "structure" in b else None} for i, b in enumerate(found)]
    return {"path": path, "file_name": name, "file_type": formats.suffix(name), "file_hash": digest, "parser_status": status, "warnings": warnings, "blocks": rows, "channel_texts": texts, "channel_status": state, "channel_reason": reason, "channels": counts}


def _recognise(name: str, data: bytes, ocr: OcrEngine, pages: int, low: float):
    try:
        r = ocr(name, data, pages)
    except Exception as e:  # an engine's failure is a status
        return [], "ocr_required", [f"ocr_failed:{type(e).__name__}"]
    text, sure = r.get("text") or "", float(r.get("confidence") or 0)
    if r.get("status") != "ok" or not text.strip():
        return [], "ocr_required", ["ocr_required"]
    warnings = ["ocr_applied"] + ([f"ocr_low_confidence:{sure:.2f}"] if sure < low else [])
    return [{"location": "pdf:ocr", "text": text, "structure": {"kind": "ocr_text", "engine": r.get("engine"), "confidence": sure, "pages_processed": int(r.get("pages_processed") or 0)}}], "ok", warnings


def manifest(files: DataFrame) -> DataFrame:
    return files.select("project_id", "file_ord", "path", "file_name", "file_type", "file_hash", "parser_status", "warnings", "channel_status", "channel_reason", "channels")


def blocks(files: DataFrame) -> DataFrame:
    return files.select("project_id", "file_ord", "file_name", F.inline("blocks"))


def channel_texts(files: DataFrame) -> DataFrame:
    return files.select("project_id", "file_ord", F.posexplode("channel_texts").alias("text_ord", "text"))


def channels(files: DataFrame) -> DataFrame:
    return files.select("project_id", "file_ord", F.explode("channels").alias("kind", "count"))


def channel_status(files: DataFrame) -> DataFrame:
    """(project_id, file_ord, status, reason, kind, count): one row for each kind of channel, or one without kind for a file without any."""
    return files.select("project_id", "file_ord", F.col("channel_status").alias("status"), F.col("channel_reason").alias("reason"), F.explode_outer("channels").alias("kind", "count"))


def _json(spark: SparkSession, path: str) -> dict:
    import json

    return json.loads(spark.read.text(path, wholetext=True).first()[0].lstrip("\ufeff"))


def _for_projects(spark: SparkSession, rows: list[tuple], columns: list[str], projects: str | DataFrame) -> DataFrame:
    """The rows of one control file for one project, or for each project of a frame."""
    schema = ", ".join(f"{c} string" for c in columns)
    if isinstance(projects, str):
        return spark.createDataFrame([(projects, *r) for r in rows], f"project_id string, {schema}")
    import json

    given = F.from_json(F.lit(json.dumps([dict(zip(columns, r)) for r in rows])), f"array<struct<{', '.join(f'{c}:string' for c in columns)}>>")
    return projects.select("project_id").distinct().select("project_id", F.inline(given))


def read_dictionary(spark: SparkSession, path: str, projects: str | DataFrame) -> DataFrame:
    """(project_id, kind, value) of a JSON dictionary; a single text counts as a list of one, other values are passed over."""
    rows = [(str(k), str(v)) for k, vs in _json(spark, path).items() for v in ([vs] if isinstance(vs, str) else vs if isinstance(vs, list) else []) if str(v).strip()]
    return _for_projects(spark, rows, ["kind", "value"], projects)


def read_decisions(spark: SparkSession, path: str, projects: str | DataFrame) -> DataFrame:
    """(project_id, candidate_id, action, strategy) of a JSON file of decisions."""
    rows = [(str(k), v.get("action"), v.get("strategy")) for k, v in _json(spark, path).items() if isinstance(v, dict)]
    return _for_projects(spark, rows, ["candidate_id", "action", "strategy"], projects)
