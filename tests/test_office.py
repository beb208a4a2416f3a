import io
import zipfile
import zlib

import pytest

from veilspark.sources import formats, office, pdf

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" mc:Ignorable="w14"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="png" ContentType="image/png"/><Default Extension="xml" ContentType="application/xml"/>{}</Types>'


def pack(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return b.getvalue()


def rels(*rows):
    return f'<Relationships xmlns="{PKG}">' + "".join(f'<Relationship Id="r{i}" Type="{REL}/{k}" Target="{t}"{" TargetMode=" + chr(34) + "External" + chr(34) if t.startswith("http") else ""}/>' for i, (k, t) in enumerate(rows)) + "</Relationships>"


def para(*runs):
    return "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


def docx(body, extra=None):
    parts = {"[Content_Types].xml": TYPES.format(""), "_rels/.rels": rels(("officeDocument", "word/document.xml")), "word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>"}
    return pack(parts | (extra or {}))


def test_channels_of_word():
    parts = {"[Content_Types].xml": TYPES.format(""), "_rels/.rels": rels(("officeDocument", "word/document.xml"), ("thumbnail", "docProps/thumbnail.png")), "docProps/thumbnail.png": b"\x89", "word/document.xml": f'<w:document {NS}><w:body>{para("正文")}<w:ins w:author="王"><w:r><w:t>新</w:t></w:r></w:ins><w:txbxContent>{para("框")}</w:txbxContent></w:body></w:document>',
             "word/_rels/document.xml.rels": rels(("header", "header1.xml"), ("image", "media/a.png"), ("hyperlink", "http://x.example")), "word/header1.xml": f"<w:hdr {NS}>{para('页眉')}<w:del><w:r/></w:del></w:hdr>", "word/media/a.png": b"\x89", "word/footnotes.xml": f"<w:footnotes {NS}/>",
             "docProps/core.xml": '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:creator>王小明</dc:creator><dc:title>题</dc:title><cp:revision>3</cp:revision></cp:coreProperties>', "customXml/item1.xml": "<secret>甲</secret>", "customXml/item2.xml": '<b:Sources xmlns:b="http://schemas.openxmlformats.org/officeDocument/2006/bibliography"/>', "word/embeddings/o.bin": b"x", "word/odd.xml": "<odd/>", "word/document2.xml": f"<w:document {NS}/>"}
    want = {"binary_media": 1, "document_properties": 2, "embedded_object": 1, "external_relationship": 1, "footnote": 1, "header": 3, "revision": 2, "text_box": 1, "thumbnail": 1, "unknown_part": 3}
    assert formats.inspect("a.docx", pack(parts)) == ("found", "", want)


def test_channels_of_excel():
    book = f'<workbook {X}><sheets><sheet name="a"/><sheet name="b" state="veryHidden"/></sheets><definedNames><definedName name="n">a!$A$1</definedName><definedName name="m"> </definedName></definedNames></workbook>'
    parts = {"[Content_Types].xml": TYPES.format(""), "xl/workbook.xml": book, "xl/worksheets/sheet1.xml": f"<worksheet {X}/>", "xl/comments1.xml": f"<comments {X}><commentList><comment><text><t>批注</t></text></comment></commentList></comments>", "xl/threadedComments/threadedComment1.xml": '<ThreadedComments xmlns="t"><threadedComment><text>甲</text></threadedComment></ThreadedComments>'}
    assert formats.inspect("a.xlsx", pack(parts)) == ("found", "", {"comment": 2, "defined_name": 1, "unknown_part": 1, "very_hidden_sheet": 1})


@pytest.mark.parametrize("extra", [{"../a.xml": "<a/>"}, {"word\\a.xml": "<a/>"}, {"word/_rels/none.xml.rels": rels()}, {"word/_rels/document.xml.rels": "<odd/>"}, {"word/styles.xml": "<!DOCTYPE a><a/>"}])
def test_broken_packages_are_unverified(extra):
    parts = {"[Content_Types].xml": TYPES.format(""), "word/document.xml": f"<w:document {NS}/>"}
    assert formats.inspect("a.docx", pack(parts | extra)) == ("unverified", "inspect_failed", {})


PAIRS = [("王小明", "人员A"), ("张三", "人员B")]


def test_copy_of_word():
    thumb = {"_rels/.rels": rels(("officeDocument", "word/document.xml"), ("thumbnail", "docProps/thumbnail.png")), "docProps/thumbnail.png": b"\x89"}
    body = para("见王", "小", "明处") + f'<w:del w:author="张三" w:date="2020"><w:r><w:delText>旧文</w:delText></w:r></w:del><w:ins w:author="李"><w:r><w:t>新张三</w:t></w:r></w:ins><w:p w14:note="张三"><w:r><w:txbxContent>{para("张", "三")}</w:txbxContent></w:r><w:r><w:t>外</w:t></w:r></w:p>'
    data = pack({"[Content_Types].xml": TYPES.format('<Override PartName="/docProps/thumbnail.png" ContentType="image/png"/>'), "word/document.xml": f"<w:document {NS}><!-- 张三 --><w:body>{body}</w:body></w:document>", "docProps/core.xml": '<c:coreProperties xmlns:c="c"><c:creator>李四</c:creator></c:coreProperties>', "word/comments.xml": f'<w:comments {NS}><w:comment w:author="甲" w:initials="j">{para("批注")}</w:comment></w:comments>'} | thumb)
    new = office.release_copy(data, True, PAIRS, ["王小明", "张三"])
    z = zipfile.ZipFile(io.BytesIO(new))
    doc = z.read("word/document.xml").decode()
    assert "见人员A" in doc and "处" in doc and "新人员B" in doc and "旧文" not in doc and "<!--" not in doc and 'w14:note="人员B"' in doc and 'mc:Ignorable="w14"' in doc and 'xmlns:w14' in doc
    assert not {"docProps/thumbnail.png"} & set(z.namelist()) and "png" not in z.read("[Content_Types].xml").decode() and "thumbnail" not in z.read("_rels/.rels").decode()
    assert "李四" not in z.read("docProps/core.xml").decode() and "批注" not in z.read("word/comments.xml").decode() and "甲" not in z.read("word/comments.xml").decode()
    assert [b["text"] for b in formats.read_docx(new)][0] == "见人员A处" and not office.holds_any(new, ["张三", "王小明"]) and office.holds_any(docx(para("王", "小明")), ["王小明"])


def test_copy_of_excel():
    data = pack({"[Content_Types].xml": TYPES.format(""), "xl/workbook.xml": f'<workbook {X}><sheets><sheet name="张三"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {X}><si><r><t>王小</t></r><r><t>明 </t></r></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {X}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>张三</t></is></c></row></sheetData></worksheet>'})
    new = office.release_copy(data, False, PAIRS, ["王小明", "张三"])
    assert formats.read_xlsx(new)[0]["text"] == "人员A | 人员B" and b"\xe5\xbc\xa0" not in zipfile.ZipFile(io.BytesIO(new)).read("xl/workbook.xml")


@pytest.mark.parametrize("data,word,reason", [
    (docx('<w:p><w:r><w:instrText>HYPERLINK</w:instrText></w:r></w:p>'), True, "active_word_field_unsupported"),
    (docx(para("a"), {"word/_rels/document.xml.rels": rels(("image", "http://x.example"))}), True, "external_relationship"),
    (docx(para("a"), {"word/_rels/document.xml.rels": rels(("header", "none.xml"))}), True, "relationship_target_missing"),
    (docx(para("a"), {"word/odd.xml": "<odd/>"}), True, "unknown_part"),
    (pack({"xl/workbook.xml": f'<workbook {X}><sheets><sheet state="hidden"/></sheets></workbook>'}), False, "hidden_sheet"),
    (docx(para("王小明")), True, "residual_after_rewrite"),
])
def test_copies_that_are_refused(data, word, reason):
    with pytest.raises(office.Unreadable, match=reason):
        office.release_copy(data, word, [("王小明", "王小明B")], ["王小明"])


def stream(head, data):
    z = zlib.compress(data)
    return b"<<" + head + b"/Filter/FlateDecode/Length %d>>\nstream\n" % len(z) + z + b"\nendstream"


def make_pdf(objects, trailer=b""):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n" % n + o + b"\nendobj\n" for n, o in objects.items()) + b"trailer\n<</Root 1 0 R" + trailer + b">>\n%%EOF"


CMAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <98797e00> endbfchar 1 beginbfrange <0002> <0003> <540d> endbfrange 1 beginbfrange <0005> <0006> [<79f0> <0041>] endbfrange"
PAGES = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1/Resources<</Font<</F1 5 0 R>>>>>>", 3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>", 4: stream(b"", b"BT /F0 9 Tf (Unit \\(a\\)) Tj 0 -12 Td [(Hel) -20 (lo)] TJ ET BT /F1 9 Tf <000100020005> Tj ET"), 5: b"<</Type/Font/ToUnicode 6 0 R>>", 6: stream(b"", CMAP)}


def test_text_of_compressed_streams():
    assert formats.parse("a.pdf", make_pdf(PAGES)) == ([{"location": "pdf:text", "text": "Unit (a)\nHello\n项縀名称"}], "ok", [])
    inner = {n: o for n, o in PAGES.items() if n in (1, 2, 3, 5)}
    body, heads = b"", b""
    for n, o in inner.items():
        heads += b"%d %d " % (n, len(body))
        body += o + b" "
    packed = {4: PAGES[4], 6: PAGES[6], 7: stream(b"/Type/ObjStm/N 4/First %d" % len(heads), heads + body)}
    assert pdf.text(make_pdf(packed)) == pdf.text(make_pdf(PAGES)) != ""
    assert pdf.text(make_pdf(PAGES, b"/Encrypt 9 0 R")) == "" and pdf.text(b"") == "" and pdf.text(b"%PDF 1 0 obj << (") == ""


def test_channels_of_pdf():
    more = PAGES | {1: b"<</Type/Catalog/Pages 2 0 R/Names<</EmbeddedFiles<</Names[(a) 9 0 R (b) 9 0 R]>>/JavaScript 9 0 R>>/AcroForm<</Fields[9 0 R]>>>>", 3: b"<</Type/Page/Contents 4 0 R/Annots[9 0 R 9 0 R 9 0 R]>>", 8: b"<</Author(\xfe\xff\x73\x8b)/Title()/Producer(p)>>", 9: b"<<>>"}
    data = make_pdf(more, b"/Info 8 0 R")
    assert formats.inspect("a.pdf", data) == ("found", "", {"annotation": 3, "attachment": 2, "document_properties": 2, "form": 1, "javascript": 1})
    assert formats.channel_texts("a.pdf", data) == ["王", "p"]
    assert formats.inspect("a.pdf", make_pdf(PAGES)) == ("clear", "", {}) and formats.inspect("a.pdf", make_pdf(PAGES, b"/Encrypt 9 0 R"))[:2] == ("unverified", "pdf_read_failed")
