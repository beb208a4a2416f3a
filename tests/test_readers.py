import io
import zipfile

import pytest

from veilspark.operators import crypto
from veilspark.sources import formats, readers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def pack(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return b.getvalue()


DOCX = pack({"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>项目名称：</w:t></w:r><w:r><w:t>甲工程</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>二</w:t></w:r></w:p></w:body></w:document>", "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>电话：13812345678</w:t></w:r></w:p></w:hdr>", "word/comments.xml": f"<w:comments {W}><w:comment><w:p><w:r><w:t>批注</w:t></w:r></w:p></w:comment></w:comments>"})
XLSX = pack({"[Content_Types].xml": "<Types/>", "xl/workbook.xml": f'<workbook {X}><sheets><sheet name="a"/><sheet name="b" state="hidden"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {X}><si><t>合同金额</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {X}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>350</v></c><c r="C1" t="s"><v>9</v></c><c r="D1" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>'})


def test_office_files():
    assert formats.parse("a.DOCX", DOCX) == ([{"location": "paragraph:1", "text": "项目名称：甲工程"}, {"location": "paragraph:3", "text": "二"}], "ok", [])
    blocks, status, _ = formats.parse("a.xlsx", XLSX)
    assert status == "ok" and blocks[0]["location"] == "sheet1:row1:A1,B1,D1" and blocks[0]["text"] == "合同金额 | 350 | x"
    assert formats.inspect("a.docx", DOCX) == ("found", "", {"comment": 2, "header": 2})
    assert formats.inspect("a.xlsx", XLSX) == ("found", "", {"hidden_sheet": 1})
    assert "电话：13812345678" in formats.channel_texts("a.docx", DOCX)


def test_failures_are_statuses():
    assert formats.parse("a.docx", b"no zip") == ([], "failed", ["parse_failed:BadZipFile"])
    assert formats.parse("a.exe", b"") == ([], "unsupported", ["unsupported_format:.exe"])
    assert formats.parse("a.pdf", b"%PDF /Subtype /Image") == ([], "ocr_required", ["ocr_required"])
    assert formats.parse("a.pdf", b"BT (Hello \\(x\\)) Tj [(a) 3 (b)] TJ ET")[0] == [{"location": "pdf:text", "text": "Hello (x)\nab"}]
    assert formats.parse("a.txt", b"")[0] == [{"location": "text:1", "text": ""}]
    evil = pack({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'})
    assert formats.parse("a.docx", evil)[1:] == ("failed", ["parse_failed:Unreadable"])
    assert formats.inspect("a.doc", b"x")[0] == "conversion_required" and formats.inspect("a.md", b"x")[0] == "clear"
    assert formats.inspect("a.pdf", b"x")[:2] == ("unverified", "pdf_read_failed") and formats.inspect("a.docx", b"x")[1] == "inspect_failed"
    big = pack({f"m{i}": "" for i in range(2049)})
    with pytest.raises(formats.Unreadable):
        formats.container(big)


def test_folder(spark, tmp_path):
    for p, data in (("p1/a.docx", DOCX), ("p1/b.txt", "电话：13912345678".encode()), ("p2/c.pdf", b"/Image")):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(data)
    engine = lambda name, data, pages: {"status": "ok", "engine": "test", "text": "识别", "confidence": 0.25, "pages_processed": pages}
    f = readers.read_files(spark, str(tmp_path), engine).cache()
    m = {r["file_name"]: r for r in readers.manifest(f).collect()}
    assert m["c.pdf"]["warnings"] == ["ocr_applied", "ocr_low_confidence:0.25"] and m["a.docx"]["project_id"] == "p1" and m["b.txt"]["file_ord"] == 2
    assert {r["location"] for r in readers.blocks(f).collect()} == {"paragraph:1", "paragraph:3", "text:1", "pdf:ocr"}
    assert {(r["kind"], r["count"]) for r in readers.channels(f).collect()} == {("header", 2), ("comment", 2)}
    assert readers.list_files(spark, str(tmp_path)).count() == 3


def test_build_command(spark, tmp_path):
    from veilspark.cli import build

    (tmp_path / "in/p1").mkdir(parents=True)
    (tmp_path / "in/p1/a.docx").write_bytes(DOCX)
    (tmp_path / "in/p1/b.txt").write_text("联系人：王小明。电话：13912345678，标签 某词", encoding="utf-8")
    (tmp_path / "dict.json").write_text('{"technical_term": ["某词", ""], "organization": "不在"}', encoding="utf-8")
    build(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "dict.json"))
    texts = " ".join(r["text"] for r in spark.read.json(str(tmp_path / "out/blocks")).collect())
    assert "王小明" not in texts and "13912345678" not in texts and "技术要素A" in texts and "人员A" in texts
    p = spark.read.json(str(tmp_path / "out/packages")).first()
    assert p["residual_scan"]["status"] == "clear" and p["residual_scan"]["hits"] == 0 and p["impact"]["overall_level"] == "pass"
    originals = {r["original"] for r in spark.read.json(str(tmp_path / "out/mapping.private")).collect()}
    assert "13812345678" in originals  # of the header


def test_encryption(spark):
    box = crypto.encrypt(spark, {"items": ["值"]}, "pass", rounds=1000)
    assert crypto.decrypt(spark, box, "pass") == {"items": ["值"]}
    for bad in ("wrong", ""):
        with pytest.raises(ValueError):
            crypto.decrypt(spark, box, bad)


def test_first_version_of_encryption(spark):
    import base64
    import hashlib
    import hmac
    import json

    salt, data = b"s" * 16, json.dumps({"items": list(range(40))}).encode()
    key = hashlib.pbkdf2_hmac("sha256", b"pw", salt, 500, dklen=32)
    stream = b"".join(hmac.digest(key, i.to_bytes(8, "big"), "sha256") for i in range(len(data) // 32 + 1))
    c = bytes(a ^ b for a, b in zip(data, stream))
    box = {"rounds": 500, "salt": base64.b64encode(salt).decode(), "ciphertext": base64.b64encode(c).decode(), "tag": base64.b64encode(hmac.digest(key, c, "sha256")).decode()}
    assert crypto.decrypt(spark, box, "pw") == {"items": list(range(40))}
    with pytest.raises(ValueError):
        crypto.decrypt(spark, box, "other")
