"""Bill XML: one row a document in, one row a content node out.

Bill text is mixed content, whose order Spark's XML reader loses, so a document is walked in Python
inside ``mapInArrow``; memory is one document and a batch of rows of bounded size. A document that cannot be
parsed gives one row with ``error`` set and no node, so a bad file never fails the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements whose text is a unit of its own, set apart from its neighbours by a blank.
BLOCKS = frozenset({
    "text", "header", "paragraph", "proviso", "subparagraph", "subsection", "section", "clause", "subclause", "quoted-block", "after-quoted-block",
    "title", "subtitle", "continuation-text", "division", "part", "chapter", "item", "subitem", "list-item", "toc", "toc-entry",
    "appropriations-major", "appropriations-intermediate", "appropriations-small", "row", "entry", "committee-name", "action", "action-date",
    "action-desc", "form", "header-in-text",
})
#: Empty elements that stand for white space.
BREAKS = frozenset({"linebreak", "pagebreak"})
#: Depth of indentation of the levels that begin a line of their own.
INDENT = {"subsection": 0, "paragraph": 1, "subparagraph": 2, "clause": 3, "subclause": 4, "item": 5, "subitem": 6}
#: Containers whose header becomes a part of the path.
CONTAINERS = frozenset({"subtitle", "part", "chapter", "subchapter"})
#: Ordinals of congresses in words, in the order they are looked for.
ORDINALS = (
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth",
    "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth",
)
#: Fixed value: the clause that every act opens with.
ENACTING = "Be it enacted by the Senate and House of Representatives of the United States of America in Congress assembled,"

# List markers that stand right behind a word, a bill's number on its cover, and title labels.
_MARKER = re.compile(r" (?=\((?:[0-9]{1,2}|[a-z]{1,4}|[A-Z])\))")
_NUMBER = re.compile(r"([A-Z])\.\s*(?:[A-Z]*\.?\s*)?(\d+)")
_TITLE = re.compile(r"TITLE\s+[^\s—]+(?:—(.*))?$")

NODE_SCHEMA = (
    "doc_id string, congress int, bill_type string, bill_number int, version_label string, official_title string, node_ord int, match_path array<string>, display_path array<string>, "
    "tag string, element_id string, header_text string, body_text string, section_number string, division_label string, display_text string, error string"
)
Element = ElementTree.Element


def _one_line(text: str) -> str:
    return " ".join(text.split())


def _flow(e: Element) -> str:
    """All text below ``e``; a block that begins with a letter or digit is set off from what precedes it, unless that is a mark like ``(a)``."""
    out, after_mark = e.text or "", False
    for child in e:
        if child.tag in BREAKS:
            out, after_mark = out + " ", False
        else:
            inner = _flow(child)
            apart = child.tag in BLOCKS and not after_mark and out[-1:].strip() and inner[:1].isalnum()
            out += (" " if apart else "") + inner
            after_mark = child.tag == "enum" and inner.lstrip().startswith("(")
        out += child.tail or ""
    return out


def plain_text(e: Element | None) -> str:
    """Text on one line, list markers attached to the word before them; ``""`` for no element."""
    return "" if e is None else _MARKER.sub("", _one_line(_flow(e)))


def display_text(e: Element) -> str:
    """Text as it reads: each level on a line of its own, indented by depth, without the element's number and header."""
    lines: list[tuple[int, list[str]]] = [(0, [])]

    def put(node: Element, depth: int, top: bool) -> None:
        lines[-1][1].append(node.text or "")
        for child in node:
            if top and child.tag in ("enum", "header"):
                continue
            if child.tag in BREAKS:
                lines[-1][1].append(" ")
            elif child.tag in INDENT and child.get("display-inline") != "yes-display-inline":
                lines.append((INDENT[child.tag], []))
                put(child, INDENT[child.tag], False)
                lines.append((depth, []))
            else:
                lines[-1][1].append(" " if child.tag in BLOCKS else "")
                put(child, depth, False)
                lines[-1][1].append(" " if child.tag == "enum" else "")
            lines[-1][1].append(child.tail or "")

    put(e, 0, True)
    done = ((depth, _one_line("".join(parts))) for depth, parts in lines)
    return "\n".join("    " * depth + text for depth, text in done if text)


def _header(e: Element) -> str:
    return plain_text(e.find("header")).strip()


def _enum(e: Element) -> str:
    return (e.findtext("enum") or "").strip()


def title_label(e: Element) -> str:
    number, header = _enum(e), _header(e)
    return header if not number else f"TITLE {number}—{header}" if header else f"TITLE {number}"


def _norm(s: str) -> str:
    return _one_line(s.lower())


@dataclass(frozen=True)
class Scope:
    """What the siblings so far say about the next one."""

    division: str = ""
    title: str = ""
    major: str | None = None
    middle: str | None = None
    name: str | None = None

    def paths(self, major: str | None, middle: str | None, leaf: str | None) -> tuple[list[str], list[str]]:
        m = _TITLE.match(self.title)
        shown, keyed = [self.division, self.title], [(m.group(1) or "") if m else self.title]
        levels = [major, middle, leaf if leaf not in (major, middle) else None]
        return [_norm(x) for x in (*keyed, *levels) if x], [x for x in (*shown, *levels) if x]


class _Walk:
    def __init__(self) -> None:
        self.nodes: list[dict] = []

    def emit(self, e: Element, paths: tuple[list[str], list[str]], header: str, body: str, shown: str, scope: Scope, tag: str, number: str = "") -> None:
        self.nodes.append({"match_path": paths[0], "display_path": paths[1], "tag": tag, "element_id": e.get("id", ""), "header_text": header, "body_text": body, "display_text": shown, "section_number": number, "division_label": scope.division})

    def account(self, e: Element, s: Scope) -> Scope:
        """An ``appropriations-*`` element: the scope it leaves for its siblings, and its node if it has text."""
        kind, header = e.tag.removeprefix("appropriations-"), _header(e)
        aside = header.startswith("(") and header.endswith(")") and len(header) > 1
        called = s.name if aside else header
        if kind == "major":
            s = replace(s, major=header, middle=None, name=header)
            paths = s.paths(s.major, None, None)
        elif kind in ("intermediate", "small"):
            s = replace(s, name=called if header else s.name)
            if kind == "intermediate":
                s = replace(s, middle=header)
                paths = s.paths(s.major, called, None)
            else:
                paths = s.paths(s.major, s.middle, called)
        else:
            return s
        body = " ".join(t for t in (plain_text(c) for c in e if c.tag not in ("header", "enum")) if t).strip()
        if body:
            self.emit(e, paths, header, body, display_text(e), s, e.tag)
        return s

    def section(self, e: Element, s: Scope, bare: bool = False) -> None:
        """A section; ``bare`` ones stand right below the body and keep their number's case in the shown path."""
        number = f"Sec. {_enum(e).rstrip('.')}" if e.findtext("enum") else ""
        paths = ([number.lower()] * bool(number), [number] * bool(number)) if bare else s.paths(s.major, s.middle, number.lower())
        text = e.find("text")
        if not bare and any(c.tag.startswith("appropriations-") for c in e):
            if text is not None:
                self.emit(e, paths, _header(e), plain_text(text), display_text(text), s, "section", number)
            for c in e:
                if c.tag.startswith("appropriations-"):
                    s = self.account(c, s)
            return
        if text is not None and e.find("subsection") is None and e.find("quoted-block") is None:
            body = plain_text(text)
        else:
            body = _MARKER.sub("", " ".join(t for t in (plain_text(c) for c in e if c.tag not in ("enum", "header")) if t)).strip()
        if body:
            self.emit(e, paths, _header(e), body, display_text(e), s, "section", number)

    def level(self, e: Element, s: Scope, inside: bool = False) -> None:
        """Children of a title or container in order; what is in a container stays in its scope."""
        for c in e:
            if c.tag.startswith("appropriations-"):
                s = self.account(c, s)
            elif c.tag == "section":
                self.section(c, s)
            elif c.tag in CONTAINERS:
                header = _header(c)
                if inside and s.major is not None:
                    middle = header if s.middle is None else " - ".join(x for x in (s.middle, header) if x)
                    below = replace(s, middle=middle, name=None)
                else:
                    below = replace(s, major=header, middle=None, name=None)
                self.level(c, below, True)

    def front(self, root: Element, body: Element) -> None:
        form = root.find("form")
        if form is None:
            return
        mast = "\n".join(t for t in (plain_text(form.find(k)).strip() for k in ("congress", "session", "legis-num", "legis-type")) if t)
        clause = ENACTING if body.get("display-enacting-clause") != "no-display-enacting-clause" else ""
        for key, text in (("masthead", mast), ("official title", plain_text(form.find("official-title")).strip()), ("enacting clause", clause)):
            if text:
                self.nodes.append({"match_path": ["front matter", key], "display_path": [], "tag": "front-matter", "element_id": "front-matter-" + key.replace(" ", "-"), "header_text": "", "body_text": text, "display_text": "", "section_number": "", "division_label": ""})

    def body(self, body: Element) -> None:
        for c in body.iterfind("section"):
            self.section(c, Scope(), bare=True)
        division = ""
        for c in body:
            if c.tag == "division":
                header = plain_text(c.find("header")).strip()
                division = f"Division {_enum(c)}" + (f": {header}" if header else "")
                for t in c.iterfind("title"):
                    self.level(t, Scope(division, title_label(t)))
            elif c.tag == "title":
                self.level(c, Scope(division, title_label(c)))


def find_body(root: Element) -> Element:
    """The text of a bill, or of the first amendment block of an amendment document."""
    body = root.find("legis-body")
    if body is None:
        block = root.find(".//engrossed-amendment-body/amendment/amendment-block")
        if block is None:
            raise ValueError("no body in the document")
        nested = block.find("legis-body")
        body = block if nested is None else nested
    return body


def metadata(root: Element, stem: str) -> dict:
    """Congress, type, number and title from the document, the version's label from its file name."""
    said = (root.findtext(".//congress") or "").strip().lower()
    digits = re.search(r"\d+", said)
    word = next((n for n, w in enumerate(ORDINALS, 1) if w in said), 0)
    number = _NUMBER.search((root.findtext(".//legis-num") or "").strip())
    kind = number.group(1).lower() if number else ""
    return {
        "congress": int(digits.group()) if digits else word + 100 * (word > 0 and "hundred" in said),
        "bill_type": "hr" if kind == "h" else kind,
        "bill_number": int(number.group(2)) if number else 0,
        "version_label": stem.split("_", 1)[1] if "_" in stem else "",
        "official_title": plain_text(root.find(".//official-title")).strip(),
    }


def parse_bill(content: bytes | str, stem: str = "") -> tuple[dict, list[dict]]:
    root = ElementTree.fromstring(content)
    body, walk = find_body(root), _Walk()
    walk.front(root, body)
    walk.body(body)
    return metadata(root, stem), walk.nodes


NODE_COLUMNS = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
_KINDS = [{"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[f.split()[1]] for f in NODE_SCHEMA.split(", ")]
#: Rows, and characters or bytes of their documents, from which a batch is handed on; a document is never split.
BATCH_ROWS, BATCH_SIZE = 2_000, 4_000_000


def node_rows(key: str | None, data: bytes | str | None) -> list[tuple]:
    """The nodes of one document as rows of ``NODE_SCHEMA``; a broken or absent one is a row with ``error``."""
    stem = re.sub(r"^.*/|\.[^./]*$", "", key or "")
    try:
        meta, nodes = parse_bill(bytes(data) if not isinstance(data, str) else data, stem)
        found = [{"doc_id": key, **meta, "node_ord": i, **n} for i, n in enumerate(nodes)]
    except (ElementTree.ParseError, ValueError, TypeError, RecursionError) as e:
        found = [{"doc_id": key, "error": f"{type(e).__name__}: {e}"}]
    return [tuple(r.get(c) for c in NODE_COLUMNS) for r in found]


def parse_documents(docs: DataFrame, doc_id: str = "path", content: str = "content") -> DataFrame:
    """Nodes of every document (``NODE_SCHEMA``). NULL and broken documents give one row with ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # most documents are short, and a batch a document costs far more than to parse it
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=NODE_COLUMNS)
        held, size = [], 0
        for batch in batches:
            for key, data in zip(*batch.columns):
                text = data.as_py()
                held += node_rows(key.as_py(), text)
                size += len(text or "")
                if held and (len(held) >= BATCH_ROWS or size >= BATCH_SIZE):
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return docs.select(F.col(doc_id).cast("string").alias("k"), F.col(content).alias("c")).mapInArrow(run, NODE_SCHEMA)


def read_bills(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of all XML files below ``path``, file names being ``<number>_<label>.xml``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").load(path)
    return parse_documents(files)


def errors(nodes: DataFrame) -> DataFrame:
    """The dead letters: documents that could not be parsed."""
    return nodes.where("error is not null").select("doc_id", "error")
