import hashlib
import json

from pyspark.sql import functions as F

from veilspark.operators import delivery


def test_acceptance_and_preflight(spark, tmp_path):
    assert all(c["ok"] for c in delivery.acceptance(spark))
    assert all(c["ok"] for c in delivery.runtime_preflight(spark, str(tmp_path)))
    assert not delivery.runtime_preflight(spark, str(tmp_path / "none"))[1]["ok"]


def test_workspace(tmp_path):
    c = [{"candidate_id": "a", "kind": "person", "placeholder": "<b>", "preservation_value": None, "strategy": "mask", "impact_level": "none"}]
    files = delivery.export_workspace(str(tmp_path), "p&q", c, "x<y", "# r")
    page = open(files["review_workspace.html"], encoding="utf-8").read()
    assert "&lt;b&gt;" in page and "p&amp;q" in page and '<option value="redact|mask" selected>' in page
    assert json.load(open(files["default_decisions.json"])) == {"a": {"action": "redact", "strategy": "mask"}}


def test_report(tmp_path):
    items = [{"original": "王小明", "placeholder": "人员A", "replacement": "人员A"}, {"original": "350万元", "placeholder": "金额区间A", "replacement": "金额区间A（100万至500万）"}]
    delivery.report_delivery({"title": "t", "summary": "人员A 用 金额区间A（100万至500万）", "recommendations": "见金额区间A"}, items, "人员A", str(tmp_path))
    assert "王小明 用 350万元" in (tmp_path / "report.restored.private.md").read_text(encoding="utf-8")
    assert "王小明" not in (tmp_path / "report.redacted.md").read_text(encoding="utf-8")


GOOD = {"residual_scan": {"status": "clear", "hits": 0}, "sources": 7, "mapping_hash": "a" * 64, "actual_mapping_hash": "a" * 64}


def source(name, data, **more):
    return {"file_name": name, "content": data, "file_hash": hashlib.sha256(data).hexdigest()} | more


def test_release(tmp_path):
    f = source
    files = [f("王小明.txt", "王小明在".encode()), f("b.md", b" "), f("c.txt", b"x", file_hash="0"), f("d.pdf", b"x"), f("e.docx", b"x"), f("g.txt", b"\xff"), f("h.txt", "张".encode())]
    m = delivery.export_release(files, [("王小明", "人员A"), ("张", "张三")], str(tmp_path), GOOD)
    assert [r["reason"] for r in m["files"]] == ["", "output_missing_or_empty", "source_hash_mismatch", "pdf_external_release_disabled", "source_parse_not_ok", "source_parse_unverified", "residual_after_rewrite"]
    assert (tmp_path / m["batch_id"] / "file_0001.txt").read_text(encoding="utf-8") == "人员A在" and m["exported_count"] == 1
    assert [p.name for p in tmp_path.iterdir()] == [m["batch_id"]]


def test_release_gates(tmp_path):
    files = [source("a.txt", "王小明在".encode()), source("b.txt", "李四在".encode()), source("c.txt", b"ok", warnings=["ocr_low_confidence:0.2"]), source("d.txt", b"ok", reason="held")]
    run = lambda package, **more: [r["reason"] for r in delivery.export_release(files, [("王小明", "人员A")], str(tmp_path), package, **more)["files"]]
    good = GOOD | {"sources": 4}
    assert run(good) == ["", "", "source_parse_unverified", "held"] and run(good, drift={"李四"}) == ["", "channel_mapping_drift", "source_parse_unverified", "held"]
    for bad, reason in (({"residual_scan": {"status": "residual_found", "hits": 1}}, "residual_not_clear"), ({"residual_scan": {"status": "clear", "hits": False}}, "residual_not_clear"), ({"residual_scan": None}, "residual_not_clear"), ({"sources": 3}, "source_evidence_missing"), ({"actual_mapping_hash": "b" * 64}, "mapping_hash_mismatch"), ({"mapping_hash": "x"}, "mapping_hash_mismatch")):
        assert run(good | bad) == [reason, reason, reason, "held"]


def test_small_parts(spark):
    df = spark.createDataFrame([("keep", None), ("redact", "range"), ("redact", "odd"), (None, None)], "a string, s string")
    assert [r[0] for r in df.select(delivery.decision_value(F.col("a"), F.col("s"))).collect()] == ["keep|keep", "redact|range", "redact|pseudonym", "redact|pseudonym"]
    assert delivery.job_summary({"status": "running", "progress": {"current": 1, "total": 3}}) == {"status": "处理中", "progress": "1/3", "error": "无"}
    assert delivery.next_actions({"convertible": 1}) == ["conversion_will_be_tried"] and delivery.next_actions({}) == ["select_other_inputs"]
    assert delivery.safe_path("/tmp/x") and not delivery.safe_path("/etc/passwd") and not delivery.safe_path("a") and not delivery.safe_path("/tmp/../etc") and not delivery.safe_path("/tmp/x", ["/data"])
    e = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "")], "project_id string, original string")
    assert [tuple(r) for r in delivery.channel_drift(e, spark.createDataFrame([("p", "a")], "project_id string, original string")).collect()] == [("p", "b")]
