"""Extraction of located rows from TEI documents and web pages.

One document is one row in and many rows out: the state of the walk (page,
folio, gathering) belongs to a document, so documents are spread over tasks.
"""

from __future__ import annotations

import io
import re
from html.parser import HTMLParser
from math import ceil
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.sources.tables import bound_batches

SCHEMA = "docid string, kind string, row_idx int, text string, bookpart string, paragraph string, page int, fol string, gathering string"


def gathering_label(gath: str, no: int) -> str:
    """X3."""
    return f"{gath}{ceil(no / 2)}{'v' if no % 2 == 0 else 'r'}" if gath and no else ""


def gathering_column(gath: Column, no: Column) -> Column:
    """X3 as an expression."""
    return F.concat(gath, F.ceil(no / 2).cast("string"), F.when(no % 2 == 0, "v").otherwise("r"))


#: Fixed values: (pattern, replacement) that bring white space and punctuation around segment markers into one form, in this order.
SEGMENT_FORMS = (
    (r"(?U)\s?(\$segstart[^$]+\$)\s?", r" $1"),
    (r"(?U)\s?(\$segend[^$]+\$)\s?", r"$1 "),
    (r"(?U)\s((?:\$seg[^$]+\$)+)$", r"$1"),
    (r"(?U)^((?:\$seg[^$]+\$)+)\s", r"$1"),
    (r"(?U)\$\s+\$", r"\$\$"),
    (r"([.?:!)]+)((?:\$segend[^$]+\$)+)", r"$2$1"),
)


def canonical_segments(text: Column) -> Column:
    """One form of white space around segment markers; punctuation moves behind end markers."""
    for pattern, put in SEGMENT_FORMS:
        text = F.regexp_replace(text, pattern, put)
    return text


def _tag(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _id(e) -> str:
    return e.get("{http://www.w3.org/XML/1998/namespace}id") or e.get("id") or ""


class _Lines:
    """Text of inline markup with line joiners and segment markers; chained segments share the first id."""

    def __init__(self):
        self.alias: dict[str, str] = {}

    def of(self, e) -> str:
        """The text of an element, with = where a word is broken. What follows an element in its line always stays."""
        out = e.text or ""
        for c in e:
            tag = _tag(c)
            if tag == "choice":
                reg = next((x for x in c if _tag(x) == "reg"), None)
                out += self.of(reg) if reg is not None else "".join(c.itertext())
            elif tag == "pc" and c.get("type") == "syllabification":
                out += "="
            elif tag in ("figure", "fw", "pb", "gb", "note"):
                pass
            elif tag == "seg" and c.get("type") == "tr":
                own = _id(c)
                seg = self.alias.get(own, own)
                inner = self.of(c)
                head = "" if c.get("prev") else f"$segstart_{seg}" + (f"_{c.get('subtype', '')}_{(c.get('corresp') or '').replace('#', '').replace(' ', '&')}" if c.get("corresp") else "") + "$"
                if c.get("next"):
                    self.alias[c.get("next").lstrip("#")] = seg
                out += head + inner + ("" if c.get("next") else f"$segend_{seg}$")
            else:
                out += self.of(c)
            out += c.tail or ""
        return out

    def joined(self, lines: list) -> str:
        """Lines one after the other: a broken word goes on in the next line, else #lb# ends a line.

        The last line keeps its mark, so that a word can be joined with the next page.
        """
        out = []
        for e in lines:
            broken = any(_tag(c) == "pc" and c.get("type") == "syllabification" for c in e)
            line = "".join(self.of(e).splitlines())
            if line:
                broken = broken or line.rstrip().endswith("=")
                out.append((line.replace("=", "").strip(), "=" if broken else "#lb#"))
        last = len(out) - 1
        return "".join(text + (mark if mark != "=" or k == last else "") for k, (text, mark) in enumerate(out))


def walk(root, page: int = 0, fol: str = "", gath: str = "", no: int = 0) -> list[tuple]:
    """(kind, text, bookpart, paragraph, page, fol, gathering) in document order, from a place to start at.

    Headers stand in lines of their own or right in a paragraph; one that points to
    another (next, prev) waits for it and both make one row where the later stands.
    The quotes of a note make one row. A gathering begins with the page after its break.
    """
    rows: list[tuple] = []
    lines, waiting, coming = _Lines(), {}, None

    for div in (e for e in root.iter() if _tag(e) == "div"):
        part = div.get("n", "")
        for p in (e for e in div if _tag(e) == "p"):
            para, held = p.get("n", ""), []

            def put(kind: str, elements: list) -> None:
                text = lines.joined(elements)
                if text:
                    rows.append((kind, text, part, para, page, fol, gathering_label(gath, no)))  # noqa: B023

            def header(fw) -> None:
                to = fw.get("next") or fw.get("prev")
                if not to:
                    put("meta", [fw])  # noqa: B023
                elif to.lstrip("#") in waiting:
                    other = waiting.pop(to.lstrip("#"))
                    put("meta", [fw, other] if fw.get("next") else [other, fw])  # noqa: B023
                else:
                    waiting[_id(fw)] = fw

            for e in p:
                tag = _tag(e)
                head = e if tag == "fw" else next((c for c in e if _tag(c) == "fw"), None) if tag == "l" and any(_tag(c) == "fw" and c.get("type") == "header" for c in e) else None
                if head is not None:
                    if head.get("type") == "header":
                        header(head)
                elif tag == "pb":
                    put("main", held)
                    held = []
                    if coming is not None:
                        gath, no, coming = coming, 0, None
                    fol, page, no = e.get("n", ""), page + 1, no + 1
                elif tag == "gb":
                    coming = e.get("n", "")
                elif tag == "note":
                    quotes = [q for q in e if _tag(q) == "quote"]
                    put("meta", [x for q in quotes for x in ([y for y in q if _tag(y) == "l"] or [q])])
                elif tag == "l":
                    held.append(e)
            put("main", held)
    return rows


def extract_tei(docs: DataFrame) -> DataFrame:
    """docs(docid, xml) as located rows; broken XML gives no rows."""

    def run(batches):
        for pdf in batches:
            out = []
            for docid, xml in zip(pdf["docid"], pdf["xml"]):
                try:
                    root = ElementTree.fromstring(xml or "")
                except ElementTree.ParseError:
                    continue
                out += [(docid, r[0], i, *r[1:]) for i, r in enumerate(walk(root))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("docid").cast("string").alias("docid"), "xml").mapInPandas(run, SCHEMA)
    return rows.withColumn("text", canonical_segments(F.col("text")))


def _start(text) -> tuple[int, str, str, int]:
    """Page, folio, gathering and number in it where a cited text begins: from="page-folio-gathering-number" of its citation."""
    cited = next((e.get("from", "") for e in text.iter() if _tag(e) == "citedRange"), "")
    m = re.fullmatch(r"(\d+)-([^-]*)-([^-]*)-(\d+)", cited)
    return (int(m[1]), m[2], m[3], int(m[4])) if m else (0, "", "", 0)


def _texts(xml: str | bytes):
    """The texts that lie below the root of a file, one after the other; each is forgotten before the next is read."""
    depth, root = 0, None
    data = xml.encode() if isinstance(xml, str) else bytes(xml)
    for event, e in ElementTree.iterparse(io.BytesIO(data), events=("start", "end")):
        if event == "start":
            root = e if root is None else root
            depth += 1
            continue
        depth -= 1
        if depth == 1 and _tag(e) == "TEI":
            yield e
            root.clear()


def extract_gold(docs: DataFrame) -> DataFrame:
    """Located rows of every text in docs(docid, xml), where a file holds several texts below one root.

    A text goes by its own id (without one: the file's and its number), its pages
    are counted on from where its citation says that it begins. Files are read as
    streams, text by text; of a file that breaks off, the texts before that stay.
    """

    def run(batches):
        for pdf in batches:
            for docid, xml in zip(pdf["docid"], pdf["xml"]):
                try:
                    for k, text in enumerate(_texts(xml or "")):
                        name = _id(text) or f"{docid}-{k}"
                        out = [(name, r[0], i, *r[1:]) for i, r in enumerate(walk(text, *_start(text)))]
                        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                except ElementTree.ParseError:
                    continue

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("docid").cast("string").alias("docid"), "xml").mapInPandas(run, SCHEMA)
    return rows.withColumn("text", canonical_segments(F.col("text")))


class _Page(HTMLParser):
    _BLOCK = frozenset("p div li h1 h2 h3 h4 h5 h6 td tr title section article br".split())

    def __init__(self):
        super().__init__()
        self.rows, self.tag, self.buffer, self.skip = [], "", "", 0

    def cut(self, tag: str) -> None:
        text = " ".join(self.buffer.split())
        if text:
            self.rows.append((self.tag, text))
        self.buffer, self.tag = "", tag

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in self._BLOCK:
            self.cut(tag)

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag in self._BLOCK:
            self.cut("")

    def handle_data(self, data):
        if not self.skip:
            self.buffer += data


def extract_pages(pages: DataFrame) -> DataFrame:
    """X1 for web pages: (page_id, row_idx, block, text) of pages(page_id, html), block by block in document order."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, html in zip(pdf["page_id"], pdf["html"]):
                p = _Page()
                p.feed(html or "")
                p.cut("")
                out += [(i, k, tag, text) for k, (tag, text) in enumerate(p.rows)]
            yield pd.DataFrame(out, columns=["page_id", "row_idx", "block", "text"])

    bound_batches(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(run, "page_id long, row_idx int, block string, text string")
