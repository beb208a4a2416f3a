import pytest
from pyspark.sql import functions as F

from veilspark.operators import audit, governance, planning, release


def row(spark, schema, values, column):
    return spark.createDataFrame([values], schema).select(column).first()[0]


@pytest.mark.parametrize("path,want", [("a/b.DOCX", "processable"), ("b.wps", "convertible"), ("x.zip", "skipped"), ("noext", "skipped"), (None, "skipped"), ("a.ppt", "unsupported"), ("dir.v2/name", "skipped"), (".hidden", "skipped")])
def test_classes(spark, path, want):
    assert row(spark, "p string", (path,), planning.classify(F.col("p"))) == want


@pytest.mark.parametrize("args,want", [(("clear", 0, 2, 2, "a" * 64, "a" * 64), None), (("clear", 1, 2, 2, "a" * 64, "a" * 64), "residual_not_clear"), ((None, 0, 2, 2, "a" * 64, "a" * 64), "residual_not_clear"), (("clear", 0, None, 2, "a" * 64, "a" * 64), "source_evidence_missing"), (("clear", 0, 2, 2, "A" * 64, "A" * 64), "mapping_hash_mismatch"), (("clear", 0, 2, 2, "a" * 64, None), "mapping_hash_mismatch")])
def test_package_gate(spark, args, want):
    c = release.package_gate(*[F.col(x) for x in "abcdef"])
    assert row(spark, "a string, b int, c int, d int, e string, f string", args, c) == want


@pytest.mark.parametrize("args,want", [(("pdf", "ok", "clear", []), "pdf_external_release_disabled"), (("txt", "ok", "clear", None), None), (("txt", "failed", "clear", []), "source_parse_not_ok"), (("md", "ok", "unverified", []), "hidden_channels_unverified"), (("docx", "ok", "found", ["comment"]), "rewrite_or_validation_failed"), (("xlsx", "ok", "found", ["comment"]), "comment"), (("zip", "ok", "clear", []), "unsupported")])
def test_file_gate(spark, args, want):
    c = release.file_gate(*[F.col(x) for x in "abcd"])
    assert row(spark, "a string, b string, c string, d array<string>", args, c) == want


def test_ocr(spark):
    q = planning.quality_gate(F.col("s"), F.col("t"), F.col("w"), F.col("n"))
    for values, want in ((("ocr_required", "pdf", [], 99), "blocked"), (("ok", "pdf", None, 3), "warning"), (("ok", "txt", None, None), "ok")):
        assert row(spark, "s string, t string, w array<string>, n int", values, q) == want
    pages = spark.createDataFrame([(1, 2, "b", 0.5), (1, 1, "a", 0.0), (1, 3, "", 0.7), (2, 1, None, None)], "k int, page int, text string, confidence double")
    assert {r["k"]: (r["text"], round(r["confidence"], 3), r["status"]) for r in planning.merge_pages(pages, "k").collect()} == {1: ("a\nb", 0.6, "ok"), 2: ("", 0.0, "empty")}
    assert [row(spark, "m string", (m,), planning.ocr_pages(F.col("m"))) for m in ("Quick", "full", None, "other")] == [1, 5, 1, 1]


def test_secrets(spark):
    df = spark.createDataFrame([(1, "a\r\napi_key = 'abcdefghijklmnop'\nx"), (2, None), (3, "-----BEGIN RSA PRIVATE KEY-----"), (4, "secret: short")], "k int, text string")
    assert sorted(tuple(r) for r in governance.secret_scan(df, "k", "text").collect()) == [(1, 2), (3, 1)]
    assert governance.config_issues({"endpoint": "x", "project_alias_id": "p", "a": {"api_key": "v"}, "b": [{"token": "${ENV}"}]}) == ["secret:a.api_key"]


def test_rules_update(spark):
    schema = "schema_version string, version string, guardrails array<string>, field_groups array<struct<name:string,default_action:string>>"
    g, s = governance.GUARDRAILS, governance.RULES_SCHEMA
    rows = [(s, "1", g, [("technical_metric", "keep"), ("amount", "range")]), (s, "1", g[:2], []), (s, "1", g, [("technical_metric", "mask")]), (s, "1", g, [("amount", None)]), ("x", "1", g, []), (s, "1", None, None)]
    assert [r["status"] for r in governance.rules_update(spark.createDataFrame(rows, schema)).collect()] == ["valid", "blocked", "blocked", "blocked", "invalid", "blocked"]
    d = governance.default_rules()
    assert governance.rules_update(spark.createDataFrame([(d["schema_version"], d["version"], d["guardrails"], [(x["name"], x["default_action"]) for x in d["field_groups"]])], schema)).first()["status"] == "valid"


def test_signatures():
    s = governance.sign("k", "100", b"body")
    assert governance.verify_signature("k", "100", b"body", s, now=350)
    assert not governance.verify_signature("k", "100", b"body", s, now=401) and not governance.verify_signature("k", "100", b"other", s, now=100)
    assert not governance.verify_signature("k", "no time", b"body", s)


def test_bundles_and_ledger(spark):
    m = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x")], "path string, size long, sha256 string")
    f = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 1, "y")], "path string, size long, sha256 string")
    assert {r["path"]: r["status"] for r in governance.verify_bundle(m, f).collect()} == {"a": "ok", "b": "size_mismatch", "c": "sha256_mismatch", "d": "missing"}
    i = spark.createDataFrame([(" ", "t")], "severity string, title string")
    assert tuple(governance.ledger(i, {"severity": "low", "title": "none"}).first()) == ("low", "t")
    j = spark.createDataFrame([("1", None, "ValueError: /secret/path", ["a"]), ("2", "failed", "", None)], "job_id string, status string, error string, files array<string>")
    assert [tuple(r) for r in governance.support_bundle(j).collect()] == [("1", "unknown", "ValueError", 1), ("2", "failed", "", 0)]


def test_channels(spark):
    f = spark.createDataFrame([("p", "found"), ("p", "unverified"), ("q", "clear"), ("r", "unsupported"), ("r", "clear")], "project_id string, status string")
    c = spark.createDataFrame([("p", "comment", 2), ("p", "comment", 1)], "project_id string, kind string, count int")
    got = {r["project_id"]: (r["overall_status"], r["channel_counts"]) for r in audit.hidden_channel_report(f, c).collect()}
    assert got == {"p": ("found", {"comment": 3}), "q": ("clear", None), "r": ("unverified", None)}


def test_jobs(spark):
    from veilspark.jobs import Jobs

    jobs = Jobs(spark)
    ok = jobs.start(lambda s, n: s.range(n).count(), 5)
    assert jobs.wait(ok)["result"] == 5 and jobs.status(ok)["status"] == "completed"
    bad = jobs.start(lambda s: 1 / 0)
    assert jobs.wait(bad)["error"] == "ZeroDivisionError" and jobs.wait(jobs.retry(bad))["status"] == "failed"
    assert jobs.status("none")["status"] == "not_found"


def test_stream(spark, tmp_path):
    from veilspark.streaming import ingest

    schema = "project_id string, doc_id int, text string"
    src = tmp_path / "src"
    for n, rows in enumerate([[("p", 1, "联系人：王小明。")], [("p", 2, "联系人：李大同。又王小明")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        s = spark.readStream.schema(schema).parquet(str(src))
        ingest.redact_stream(s, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "联系人：人员A。", 2: "联系人：人员B。又人员A"}
    d = ingest.detected_stream(spark.readStream.schema(schema).parquet(str(src)), "text")
    q = d.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["original"] for r in spark.sql("select * from seen").collect()} == {"王小明", "李大同"}


def test_allowed_expressions_and_private_files(spark, tmp_path):
    from veilspark.operators import crypto

    df = spark.createDataFrame([(1, "ok\nsecret = service_secret_of_app\napi_key: 'abcdefghijklmnop' secret = service_secret_of_app")], "k int, t string")
    assert [r["line"] for r in governance.secret_scan(df, "k", "t").collect()] == [2, 3]
    assert [r["line"] for r in governance.secret_scan(df, "k", "t", ["secret = service_secret_of_app"]).collect()] == [3]
    plain = tmp_path / "m.json"
    plain.write_text("{}")
    crypto.write_private(str(tmp_path / "m.enc"), {"a": 1}, str(plain))
    assert not plain.exists() and (tmp_path / "m.enc").stat().st_mode & 0o77 == 0


def test_streaming_store_that_cannot_be_read_rises(spark, tmp_path):
    from veilspark.streaming.ingest import _stored

    assert _stored(spark, str(tmp_path / "none"), "a string").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        _stored(spark, str(tmp_path / "bad"), "a string").count()
