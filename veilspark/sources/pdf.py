"""A small reader of PDF files: objects, compressed streams, text of pages, and channels beside it. Standard library only.

Objects are found by their markers and in object streams, so damaged cross-reference tables do not matter. Encrypted files are refused."""

from __future__ import annotations

import re
import zlib
from typing import Any

MAX_STREAM_BYTES = 64 << 20
PROPERTIES = ("Author", "Title", "Creator", "Producer", "Subject", "Keywords")

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_SPACE, _DELIMITER = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
_TOKEN = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class PdfError(ValueError):
    """A file that cannot be read as PDF."""


class Name(str):
    """A name object."""


class Operator(str):
    """A word that is neither number nor name."""


class Reference(int):
    """The number of another object."""


class Scanner:
    """Reads objects one after another from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _skip(self) -> None:
        d = self.data
        while self.at < len(d):
            if d[self.at] in _SPACE:
                self.at += 1
            elif d[self.at : self.at + 1] == b"%":
                end = re.compile(rb"[\r\n]").search(d, self.at)
                self.at = end.end() if end else len(d)
            else:
                return

    def next(self) -> Any:
        """The next object; StopIteration at the end."""
        self._skip()
        d, c = self.data, self.data[self.at : self.at + 1]
        if not c:
            raise StopIteration
        if c == b"/":
            m = _TOKEN.match(d, self.at + 1)
            self.at = m.end() if m else self.at + 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[0] if m else b"").decode("utf-8", "replace"))
        if c == b"(":
            return self._string()
        if d.startswith(b"<<", self.at):
            self.at += 2
            items = self._until(b">>")
            return dict(zip(items[::2], items[1::2]))
        if c == b"<":
            end = d.find(b">", self.at)
            if end < 0:
                raise PdfError("open string")
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            return self._until(b"]")
        if c in b")>]{}":
            self.at += 1
            return Operator(c.decode())
        m = _TOKEN.match(d, self.at)
        self.at, word = m.end(), m[0]
        if re.fullmatch(rb"[+-]?\d+", word):
            if word.isdigit() and (r := re.compile(rb"\s+\d+\s+R(?![A-Za-z])").match(d, self.at)):
                self.at = r.end()
                return Reference(word)
            return int(word)
        if re.fullmatch(rb"[+-]?\d*\.\d*", word) and len(word) > 1:
            return float(re.sub(rb"\.$", b".0", word))
        return {b"true": True, b"false": False, b"null": None}.get(word, Operator(word.decode("latin-1")))

    def _until(self, end: bytes) -> list:
        out = []
        while True:
            self._skip()
            if self.data.startswith(end, self.at):
                self.at += len(end)
                return out
            try:
                out.append(self.next())
            except StopIteration:
                raise PdfError("open object") from None

    def _string(self) -> bytes:
        d, i, depth, out = self.data, self.at + 1, 1, bytearray()
        while i < len(d):
            c = d[i : i + 1]
            if c == b"\\":
                if m := re.compile(rb"[0-7]{1,3}").match(d, i + 1):
                    out.append(int(m[0], 8) & 255)
                    i = m.end()
                    continue
                follow = d[i + 1 : i + 2]
                if follow == b"\r" and d[i + 2 : i + 3] == b"\n":
                    i += 1
                elif follow not in b"\r\n":
                    out += _ESCAPES.get(follow, follow)
                i += 2
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                self.at = i + 1
                return bytes(out)
            out += c
            i += 1
        raise PdfError("open string")


def inflate(data: bytes) -> bytes:
    d = zlib.decompressobj()
    out = d.decompress(data, MAX_STREAM_BYTES)
    if d.unconsumed_tail:
        raise PdfError("stream too long")
    return out


class Document:
    """The objects of a file by number."""

    def __init__(self, data: bytes):
        self.data, self.objects, self.streams = data, {}, {}
        self.trailer: dict = {}
        for m in _OBJECT.finditer(data):
            self._add(int(m[1]), Scanner(data, m.end()))
        for m in re.finditer(rb"\btrailer\b", data):
            try:
                self.trailer |= Scanner(data, m.end()).next()
            except (PdfError, StopIteration, TypeError, ValueError):
                continue
        for o in list(self.objects.values()):
            if isinstance(o, dict) and o.get("Type") == "XRef":
                self.trailer |= {k: v for k, v in o.items() if k in ("Root", "Info", "Encrypt")}
        if "Encrypt" in self.trailer:
            raise PdfError("encrypted")
        for n in [n for n, o in self.objects.items() if isinstance(o, dict) and o.get("Type") == "ObjStm"]:
            self._unpack(n)

    def _add(self, number: int, scanner: Scanner) -> None:
        try:
            o = scanner.next()
        except (PdfError, StopIteration, ValueError, AttributeError):
            return
        self.objects[number] = o
        if isinstance(o, dict) and (m := re.compile(rb"\s*stream\r?\n?").match(self.data, scanner.at)):
            end = self.data.find(b"endstream", m.end())
            self.streams[number] = self.data[m.end() : end if end >= 0 else len(self.data)]

    def _unpack(self, number: int) -> None:
        head, data = self.objects[number], self.stream(number)
        scanner, pairs = Scanner(data), []
        for _ in range(int(self.value(head["N"]))):
            pairs.append((scanner.next(), scanner.next()))
        for n, offset in pairs:
            if n not in self.objects:
                self.objects[n] = Scanner(data, int(self.value(head["First"])) + offset).next()

    def value(self, o: Any) -> Any:
        for _ in range(32):
            if not isinstance(o, Reference):
                return o
            o = self.objects.get(int(o))
        raise PdfError("circular reference")

    def stream(self, number: int) -> bytes:
        head, data = self.objects[number], self.streams[number]
        length = self.value(head.get("Length"))
        if isinstance(length, int) and 0 <= length <= len(data):
            data = data[:length]
        kinds = self.value(head.get("Filter")) or []
        for f in kinds if isinstance(kinds, list) else [kinds]:
            if f not in ("FlateDecode", "Fl"):
                raise PdfError(f"filter {f}")
            data = inflate(data)
        return data

    def root(self) -> dict:
        root = self.value(self.trailer.get("Root"))
        if not isinstance(root, dict):
            root = next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), None)
        if root is None:
            raise PdfError("no catalog")
        return root

    def pages(self) -> list[dict]:
        """The pages in order, with what they inherit."""
        out, todo, seen = [], [(self.root().get("Pages"), {})], set()
        while todo:
            ref, above = todo.pop()
            node = self.value(ref)
            if not isinstance(node, dict) or isinstance(ref, Reference) and int(ref) in seen:
                continue
            if isinstance(ref, Reference):
                seen.add(int(ref))
            here = above | {k: node[k] for k in ("Resources",) if k in node}
            if "Kids" in node:
                todo += [(k, here) for k in reversed(self.value(node["Kids"]) or [])]
            else:
                out.append(here | node)
        return out


def _unicode_table(data: bytes) -> tuple[int, dict[int, str]]:
    """(bytes of a code, code -> text) of a font's table to Unicode."""
    table, width, stack, scanner = {}, 1, [], Scanner(data)
    text = lambda b: b.decode("utf-16-be", "replace")
    while True:
        try:
            o = scanner.next()
        except StopIteration:
            return width, table
        if not isinstance(o, Operator):
            stack.append(o)
            continue
        if o == "endcodespacerange" and stack and isinstance(stack[-1], bytes):
            width = max(width, len(stack[-1]))
        elif o == "endbfchar":
            for a, b in zip(stack[::2], stack[1::2]):
                table[int.from_bytes(a)] = text(b)
        elif o == "endbfrange":
            for a, b, c in zip(stack[::3], stack[1::3], stack[2::3]):
                first, last = int.from_bytes(a), int.from_bytes(b)
                for i in range(min(last - first, 0xFFFF) + 1):
                    if isinstance(c, list):
                        if i < len(c):
                            table[first + i] = text(c[i])
                    else:
                        table[first + i] = text(c[:-2] + (int.from_bytes(c[-2:]) + i & 0xFFFF).to_bytes(2))
        stack = []


def _plain(b: bytes) -> str:
    try:
        return b.decode("utf-8")
    except UnicodeDecodeError:
        return b.decode("utf-16", "replace") if b[:2] in (b"\xfe\xff", b"\xff\xfe") else b.decode("cp1252", "replace")


def _decode(b: bytes, font: tuple[int, dict[int, str]] | None) -> str:
    if not font:
        return _plain(b)
    width, table = font
    return "".join(table.get(int.from_bytes(b[i : i + width]), "") for i in range(0, len(b), width))


def page_text(doc: Document, page: dict) -> str:
    fonts = {}
    resources = doc.value(page.get("Resources")) or {}
    for name, ref in (doc.value(resources.get("Font")) or {}).items():
        font = doc.value(ref)
        table = font.get("ToUnicode") if isinstance(font, dict) else None
        fonts[name] = _unicode_table(doc.stream(int(table))) if isinstance(table, Reference) and int(table) in doc.streams else None
    contents = page.get("Contents")
    parts = contents if isinstance(contents, list) else doc.value(contents) if isinstance(doc.value(contents), list) else [contents]
    data = b"\n".join(doc.stream(int(c)) for c in parts if isinstance(c, Reference) and int(c) in doc.streams)
    out, line, stack, font, scanner = [], [], [], None, Scanner(data)
    while True:
        try:
            o = scanner.next()
        except StopIteration:
            break
        if not isinstance(o, Operator):
            stack.append(o)
            continue
        if o == "Tf" and len(stack) > 1:
            font = fonts.get(stack[-2])
        elif o in ("Td", "TD", "Tm", "T*", "ET", "'", '"') and line and not (o == "Td" and len(stack) > 1 and stack[-1] == 0):
            out.append("".join(line))
            line = []
        if o in ("Tj", "'", '"') and stack and isinstance(stack[-1], bytes):
            line.append(_decode(stack[-1], font))
        elif o == "TJ" and stack and isinstance(stack[-1], list):
            line.append("".join(_decode(x, font) for x in stack[-1] if isinstance(x, bytes)))
        elif o == "BI":  # an inline image is no text
            end = re.compile(rb"\sEI(?=\s|$)").search(data, scanner.at)
            scanner.at = end.end() if end else len(data)
        stack = []
    return "\n".join(x for x in [*out, "".join(line)] if x.strip())


def text(data: bytes) -> str:
    """The text of all pages; empty where the file has none or cannot be read."""
    try:
        doc = Document(data)
        pages = [page_text(doc, p) for p in doc.pages()]
    except (PdfError, zlib.error, StopIteration, KeyError, TypeError, ValueError):
        return ""
    return "\n".join(p for p in pages if p.strip())


def _leaves(doc: Document, tree: Any, depth: int = 0) -> int:
    """Entries of a name tree."""
    node = doc.value(tree)
    if not isinstance(node, dict) or depth > 32:
        return 0
    return len(doc.value(node.get("Names")) or []) // 2 + sum(_leaves(doc, k, depth + 1) for k in doc.value(node.get("Kids")) or [])


def properties(doc: Document) -> list[str]:
    info = doc.value(doc.trailer.get("Info")) or {}
    values = [doc.value(info.get(k)) for k in PROPERTIES]
    return [t for v in values if isinstance(v, bytes) and (t := _plain(v).strip())]


def _names(doc: Document) -> dict:
    return doc.value(doc.root().get("Names")) or {}


def _scripts(doc: Document) -> int:
    action = doc.value(doc.root().get("OpenAction"))
    return int(_names(doc).get("JavaScript") is not None or isinstance(action, dict) and any(k in action for k in ("JS", "JavaScript")))


#: Channels in the order in which they are looked for, and the reason where that fails (fixed values).
CHANNELS = [
    ("document_properties", "pdf_metadata_unverified", lambda d: len(properties(d))),
    ("attachment", "pdf_attachment_unverified", lambda d: _leaves(d, _names(d).get("EmbeddedFiles"))),
    ("form", "pdf_form_unverified", lambda d: len(d.value((d.value(d.root().get("AcroForm")) or {}).get("Fields")) or [])),
    ("annotation", "pdf_annotation_unverified", lambda d: sum(len(d.value(p.get("Annots")) or []) for p in d.pages())),
    ("javascript", "pdf_javascript_unverified", _scripts),
]


def channels(data: bytes) -> tuple[str, str, dict[str, int]]:
    """(status, reason, counts by kind)."""
    try:
        doc = Document(data)
        doc.root()
    except (PdfError, zlib.error, StopIteration, KeyError, TypeError, ValueError):
        return "unverified", "pdf_read_failed", {}
    counts: dict[str, int] = {}
    for kind, reason, count in CHANNELS:
        try:
            n = count(doc)
        except (PdfError, zlib.error, StopIteration, KeyError, TypeError, ValueError, AttributeError):
            return "unverified", reason, counts
        if n:
            counts[kind] = n
    return ("found" if counts else "clear"), "", counts
