"""Office packages after the Open Packaging Conventions: what each part is, what hides in it, and copies with values replaced.

A part's role follows from its declared content type, else from the relationship that leads to it, else from its root element, else from
its default name; one table holds all four. What has no role is unknown, and a second part of a role that a package has once is too."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from typing import NamedTuple
from urllib.parse import unquote, urlsplit
from xml.dom import minidom
from xml.etree import ElementTree
from xml.parsers import expat

from veilspark.operators.redact import Replacer, redact_runs

MAX_MEMBERS, MAX_MEMBER_BYTES, MAX_TOTAL_BYTES = 2048, 64 << 20, 256 << 20
WORD, SHEET = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONSHIPS = "http://schemas.openxmlformats.org/package/2006/relationships"


class Unreadable(ValueError):
    """A file that breaks a rule of its format."""


class Role(NamedTuple):
    """What a part is: default name, last words of its content type and relationship type, root element, and whether a package has it once."""

    name: str
    content: str
    relation: str
    root: str
    once: bool = False


#: Roles of Office Open XML (fixed values of the standard).
ROLES = [
    Role("document", "wordprocessingml.document.main", "officeDocument", "document", True),
    Role("styles", "styles", "styles", "styles"),
    Role("styles", "spreadsheetml.styles", "styles", "styleSheet"),
    Role("stylesWithEffects", "stylesWithEffects", "stylesWithEffects", "styles"),
    Role("settings", "settings", "settings", "settings", True),
    Role("webSettings", "webSettings", "webSettings", "webSettings", True),
    Role("fontTable", "fontTable", "fontTable", "fonts", True),
    Role("numbering", "numbering", "numbering", "numbering", True),
    Role("theme", "theme", "theme", "theme"),
    Role("comments", "comments", "comments", "comments", True),
    Role("footnotes", "footnotes", "footnotes", "footnotes", True),
    Role("endnotes", "endnotes", "endnotes", "endnotes", True),
    Role("header", "header", "header", "hdr"),
    Role("footer", "footer", "footer", "ftr"),
    Role("workbook", "spreadsheetml.sheet.main", "officeDocument", "workbook", True),
    Role("sheet", "worksheet", "worksheet", "worksheet"),
    Role("sharedStrings", "sharedStrings", "sharedStrings", "sst", True),
    Role("calcChain", "calcChain", "calcChain", "calcChain", True),
    Role("core", "core-properties", "core-properties", "coreProperties", True),
    Role("app", "extended-properties", "extended-properties", "Properties", True),
    Role("custom", "custom-properties", "custom-properties", "Properties", True),
    Role("threadedComment", "threadedcomments", "threadedComment", "ThreadedComments"),
]
PROPERTIES = ("core", "app", "custom")
#: Custom data that holds nothing of its own (fixed values).
PLAIN_CUSTOM = {("http://schemas.openxmlformats.org/officeDocument/2006/bibliography", "Sources"), ("http://schemas.openxmlformats.org/officeDocument/2006/customXml", "datastoreItem")}
#: What a part that is no XML may be, by the words of its relationship or folder (fixed values of the standard).
OPAQUE = {"oleObject": "embedded_object", "package": "embedded_object", "embeddings": "embedded_object", "image": "binary_media", "video": "binary_media", "audio": "binary_media", "media": "binary_media", "thumbnail": "thumbnail"}
PROPERTY_ELEMENTS = {"creator", "lastModifiedBy", "title", "subject", "description"}
BLOCKING = {"embedded_object", "binary_media", "unknown_part", "external_relationship", "hidden_sheet", "very_hidden_sheet", "comment"}


def xml(data: bytes) -> ElementTree.Element:
    """The root of a part; document types and entities are refused."""
    guard = expat.ParserCreate()

    def refuse(*_):
        raise Unreadable("xml_dtd_unsupported")

    guard.StartDoctypeDeclHandler = guard.EntityDeclHandler = refuse
    guard.Parse(data, True)
    return ElementTree.fromstring(data)


def container(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    sizes = [i.file_size for i in z.infolist()]
    if len(sizes) > MAX_MEMBERS or max(sizes, default=0) > MAX_MEMBER_BYTES or sum(sizes) > MAX_TOTAL_BYTES:
        raise Unreadable("zip_budget_exceeded")
    return z


def split(tag: str) -> tuple[str, str]:
    """(namespace, local name) of a tag."""
    return tuple(tag[1:].split("}", 1)) if tag[:1] == "{" else ("", tag)


def local(tag: str) -> str:
    return split(tag)[1]


class Relation(NamedTuple):
    source: str
    kind: str
    target: str
    external: bool


class Package:
    """The parts of a package, read once."""

    def __init__(self, data: bytes):
        z = container(data)
        members = [n for n in z.namelist() if not n.endswith("/")]
        if len(members) != len(set(members)):
            raise Unreadable("duplicate_zip_member")
        for n in members:
            if posixpath.normpath(n) != n or "\\" in n or n.startswith(("/", "../")):
                raise Unreadable("unsafe_zip_member")
        self.data = {n: z.read(n) for n in members}
        self.roots: dict[str, ElementTree.Element | None] = {}
        self.relations = [r for n in members if n.endswith(".rels") for r in self._relations(n)]
        self.types = self._types()
        self.leads: dict[str, str] = {}
        for r in self.relations:
            if not r.external:
                self.leads.setdefault(r.target, r.kind)
        self.roles = self._roles()

    def root(self, name: str) -> ElementTree.Element | None:
        """The root element of an XML part, None of another."""
        if name not in self.roots:
            isxml = name.endswith((".xml", ".rels")) or self.types.get(name, "").endswith("xml")
            self.roots[name] = xml(self.data[name]) if isxml else None
        return self.roots[name]

    def _relations(self, name: str) -> list[Relation]:
        self.roots[name] = root = xml(self.data[name])
        folder, _, owner = name.rpartition("_rels/")
        if split(root.tag) != (RELATIONSHIPS, "Relationships") or any(split(e.tag) != (RELATIONSHIPS, "Relationship") for e in root) or not (folder.endswith("/") or name == "_rels/.rels"):
            raise Unreadable("unknown_relationship_part")
        source = folder + owner.removesuffix(".rels")
        if source and source not in self.data:
            raise Unreadable("orphan_relationship_part")
        out = []
        for e in root:
            target, external = e.get("Target", ""), e.get("TargetMode", "").lower() == "external"
            path = unquote(urlsplit(target).path) if not external else target
            out.append(Relation(source, e.get("Type", "").rsplit("/", 1)[-1], path.lstrip("/") if path.startswith("/") or external else posixpath.normpath(posixpath.join(folder, path)), external))
        return out

    def _types(self) -> dict[str, str]:
        if "[Content_Types].xml" not in self.data:
            return {}
        self.roots["[Content_Types].xml"] = root = xml(self.data["[Content_Types].xml"])
        return {e.get("PartName", "").lstrip("/"): e.get("ContentType", "") for e in root if local(e.tag) == "Override"}

    def _roles(self) -> dict[str, str]:
        """Part -> role, 'relationships' or 'types' for the plumbing, the kind of channel in angle brackets for what no rule can see."""
        out, taken = {}, set()
        for n in sorted(self.data):
            if n.endswith(".rels") or n == "[Content_Types].xml":
                out[n] = "plumbing"
                continue
            role = self._role(n)
            if role is not None and role.once:
                if role.name in taken:
                    role = None
                taken.add(role.name if role else "")
            out[n] = role.name if role else self._opaque(n)
        return out

    def _role(self, name: str) -> Role | None:
        words = name.split("/")[:-1]
        if any(w in OPAQUE for w in words) or OPAQUE.get(self.leads.get(name, "")):
            return None
        root = self.root(name)
        if root is None or words[:1] == ["customXml"]:
            return None
        tail = re.sub(r"\+xml$", "", self.types.get(name, "")).rsplit("/", 1)[-1]
        declared = [r for r in ROLES if tail and (tail.endswith("." + r.content) or tail.endswith("-" + r.content) or tail == r.content)]
        led = [r for r in ROLES if r.relation == self.leads.get(name) and r.root == local(root.tag)]
        rooted = [r for r in ROLES if r.root == local(root.tag)]
        named = [r for r in ROLES if r.name == re.sub(r"\d+$", "", posixpath.basename(name).rsplit(".", 1)[0])]
        both = [r for r in rooted if r in named]
        for found in (declared, led, both, named, rooted):
            if found:
                return found[0] if found[0].name != "threadedComment" else None
        return None

    def _opaque(self, name: str) -> str:
        words = [self.leads.get(name, ""), *name.split("/")[:-1], re.sub(r"\d+$", "", posixpath.basename(name).rsplit(".", 1)[0])]
        for w in words:
            if w in OPAQUE:
                return f"<{OPAQUE[w]}>"
        if name.split("/")[0] == "customXml" and (root := self.root(name)) is not None and split(root.tag) in PLAIN_CUSTOM:
            return "plain"
        return "<unknown_part>"

    def of(self, *roles: str) -> list[str]:
        return [n for n, r in self.roles.items() if r in roles]


def stories(root: ElementTree.Element) -> list[str]:
    """All texts of a part: its paragraphs and strings joined, its nodes, its attributes."""
    out = []
    for e in root.iter():
        if split(e.tag) in ((WORD, "p"), (SHEET, "si"), (SHEET, "is")):
            out.append("".join(e.itertext()))
        out += [(e.text or "").strip(), *e.attrib.values()]
    return [t for t in out if t.strip()]


def channel_texts(data: bytes) -> list[str]:
    """Private texts of all parts, in the order of parts."""
    p = Package(data)
    return [t for n in p.data if (root := p.root(n)) is not None for t in stories(root)]


def channels(data: bytes, word: bool) -> dict[str, int]:
    """Counts of hidden channels by kind."""
    p = Package(data)
    counts: dict[str, int] = {}

    def add(kind: str, n: int) -> None:
        if n:
            counts[kind] = counts.get(kind, 0) + n

    for r in p.roles.values():
        if r[0] == "<":
            add(r[1:-1], 1)
    add("external_relationship", len({r.source for r in p.relations if r.external}))
    texts = lambda names: sum(len(stories(p.root(n))) for n in names)
    add("document_properties", sum(1 for n in p.of(*PROPERTIES) for e in p.root(n).iter() if local(e.tag) in PROPERTY_ELEMENTS and (e.text or "").strip()))
    threads = [n for n in p.data if "threadedcomment" in n.lower() and p.root(n) is not None]
    if word:
        for role, kind in (("header", "header"), ("footer", "footer"), ("footnotes", "footnote"), ("endnotes", "endnote"), ("comments", "comment")):
            add(kind, texts(p.of(role)))
        inside = [local(e.tag) for n in p.data if n.startswith("word/") and not n.endswith(".rels") and p.root(n) is not None for e in p.root(n).iter()]
        add("revision", sum(map(inside.count, ("ins", "del", "moveFrom", "moveTo"))))
        add("text_box", inside.count("txbxContent"))
    else:
        for n in p.of("workbook"):
            for e in p.root(n).iter():
                if local(e.tag) == "sheet" and e.get("state") in ("hidden", "veryHidden"):
                    add("hidden_sheet" if e.get("state") == "hidden" else "very_hidden_sheet", 1)
                elif local(e.tag) == "definedName":
                    add("defined_name", int(bool((e.text or "").strip())))
        add("comment", texts([*p.of("comments"), *threads]))
    return counts


def _blocked(data: bytes, word: bool) -> str:
    """The channel that forbids a copy, or ''."""
    bad = set(channels(data, word)) & (BLOCKING - ({"comment"} if word else set()))
    return "external_relationship" if "external_relationship" in bad else min(bad, default="")


#: Attributes that name people and times (fixed values).
PERSONAL_ATTRIBUTES = {"author", "initials", "date", "dateUtc", "name"}
ACTIVE = {"instrText", "fldSimple", "altChunk"}


def _walk(node):
    yield node
    for c in node.childNodes:
        yield from _walk(c)


def _elements(node, *names: str):
    return [e for e in _walk(node) if e.nodeType == e.ELEMENT_NODE and e.localName in names]


def _text_of(element) -> str:
    return "".join(c.data for c in element.childNodes if c.nodeType in (c.TEXT_NODE, c.CDATA_SECTION_NODE))


def _set_text(document, element, text: str) -> None:
    for c in list(element.childNodes):
        element.removeChild(c)
    if text:
        element.appendChild(document.createTextNode(text))
        if text != text.strip():
            element.setAttribute("xml:space", "preserve")


def _wipe(node) -> None:
    for e in _walk(node):
        if e.nodeType in (e.TEXT_NODE, e.CDATA_SECTION_NODE):
            e.data = ""
        elif e.nodeType == e.ELEMENT_NODE:
            _blank(e, PERSONAL_ATTRIBUTES)


def _blank(element, names: set[str]) -> None:
    for a in list(element.attributes.values()):
        if (a.localName or a.name) in names:
            element.setAttribute(a.name, "")


def _own(paragraph, text_name: str, border: str) -> list:
    """The text elements of a paragraph that belong to no paragraph within it."""
    out, todo = [], [paragraph]
    while todo:
        e = todo.pop()
        if e.nodeType != e.ELEMENT_NODE or e is not paragraph and e.localName == border:
            continue
        if e.localName == text_name:
            out.append(e)
        else:
            todo += reversed(e.childNodes)
    return out


class Rewriter:
    """Copies packages with values replaced, in whatever runs they stand."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = [(a, b) for a, b in pairs if a]
        self.change = Replacer(self.pairs)

    def _joined(self, document, elements: list, done: set[int]) -> None:
        done.update(map(id, elements))
        old = [_text_of(e) for e in elements]
        for e, a, b in zip(elements, old, redact_runs(old, self.pairs)):
            if a != b:
                _set_text(document, e, b)

    def part(self, data: bytes, role: str, word: bool) -> bytes:
        document = minidom.parseString(data)
        for e in [x for x in _walk(document) if x.nodeType in (x.COMMENT_NODE, x.PROCESSING_INSTRUCTION_NODE)]:
            e.parentNode.removeChild(e)
        root, done = document.documentElement, set()
        if role in PROPERTIES or role == "comments":
            _wipe(root)
        if word:
            if _elements(root, *ACTIVE):
                raise Unreadable("active_word_field_unsupported")
            for e in _elements(root, "del", "moveFrom"):
                _wipe(e)
            for e in _elements(root, "comment", "ins", "del", "moveFrom", "moveTo"):
                _blank(e, PERSONAL_ATTRIBUTES - {"name"})
            for e in _elements(root, "p"):
                self._joined(document, _own(e, "t", "p"), done)
        else:
            if any(e.getAttribute("state") in ("hidden", "veryHidden") for e in _elements(root, "sheet")):
                raise Unreadable("hidden_sheet")
            for e in _elements(root, "si", "is"):
                self._joined(document, _own(e, "t", "si"), done)
        for e in _walk(root):
            if e.nodeType in (e.TEXT_NODE, e.CDATA_SECTION_NODE):
                if id(e.parentNode) not in done:
                    e.data = self.change(e.data)
            elif e.nodeType == e.ELEMENT_NODE:
                for a in list(e.attributes.values()):
                    if not a.name.startswith("xmlns") and (new := self.change(a.value)) != a.value:
                        e.setAttribute(a.name, new)
        return document.toxml("utf-8")

    def copy(self, data: bytes, word: bool) -> bytes:
        """The package without thumbnails, with values replaced; Unreadable with the reason where that is not possible."""
        if reason := _blocked(data, word):
            raise Unreadable(reason)
        p = Package(data)
        gone = set(p.of("<thumbnail>"))
        if any(not r.external and r.target not in p.data for r in p.relations):
            raise Unreadable("relationship_target_missing")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, d in p.data.items():
                if n in gone:
                    continue
                if n.endswith(".rels"):
                    d = self._without(d, "Relationship", "Target", lambda t, n=n: posixpath.normpath(posixpath.join(n.rpartition("_rels/")[0], t.lstrip("/"))) in gone)
                elif n == "[Content_Types].xml" and gone:
                    extensions = {g.rsplit(".", 1)[-1].lower() for g in gone}
                    d = self._without(self._without(d, "Override", "PartName", lambda t: t.lstrip("/") in gone), "Default", "Extension", lambda t: t.lower() in extensions)
                elif p.root(n) is not None and p.roles[n] != "plumbing":
                    d = self.part(d, p.roles[n], word and n.startswith("word/"))
                z.writestr(n, d)
        return out.getvalue()

    @staticmethod
    def _without(data: bytes, element: str, attribute: str, gone) -> bytes:
        document = minidom.parseString(data)
        for e in _elements(document, element):
            if gone(e.getAttribute(attribute)):
                e.parentNode.removeChild(e)
        return document.toxml("utf-8")


def holds_any(data: bytes, needles: list[str]) -> bool:
    """Whether a needle stands anywhere in a package: in names of parts, in texts across runs, in attributes or namespaces."""
    p = Package(data)
    seen = list(p.data)
    for n in p.data:
        if (root := p.root(n)) is None:
            raise Unreadable("unknown_part")
        seen += ["".join(root.itertext()), *(v for e in root.iter() for v in (*e.attrib.values(), split(e.tag)[0]))]
    whole = "\n".join(seen)
    return any(x and x in whole for x in needles)


def release_copy(data: bytes, word: bool, pairs: list[tuple[str, str]], needles: list[str]) -> bytes:
    """A copy that was read again and holds no needle; Unreadable with the reason where there is none."""
    new = Rewriter(pairs).copy(data, word)
    again = Package(new)
    if not again.of("document" if word else "workbook") and not (not word and again.of("sheet")):
        raise Unreadable("rewrite_or_validation_failed")
    if _blocked(new, word):
        raise Unreadable("rewrite_or_validation_failed")
    if holds_any(new, needles):
        raise Unreadable("residual_after_rewrite")
    return new
