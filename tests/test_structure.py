"""Structure of volumes, headers in pairs, notes, forms of segment markers, passages that meet in stretches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.operators import extract, matches, structure
from textloom.plans import drivers

FORMULA = [("A", "B", 2, False), ("a", "b", 1, True)]
TEXTS = ["xii.", "Keyser", "Coninck", "Parijs", "Roemsche Kuninck", "plain words stand here", "Bisschof", "Vrancrijch", "ab cd", None, ""]


def numeral(t):
    return len(t) <= 12 and len(re.sub(r"[ijvuxlcdm.\s]", "", t)) <= 3


def roles(lines, page):
    """The first lines of a page, one by one."""
    side = structure.HEADERS["verso" if page % 2 == 0 else "recto"]
    known = lambda k, t: k in side and re.search(side[k], t) is not None
    where = {}
    for i, (t, _) in enumerate(lines):
        t = t or ""
        if "page" not in where and numeral(t):
            where["page"] = i
        elif ("first" not in where and known("first", t)) or known("first_again", t):
            where["first"] = i
        elif ("second" not in where and known("second", t)) or known("second_again", t):
            where["second"] = i
    if not where and lines[0][1]:
        return ["header"] + ["text"] * (len(lines) - 1)
    if where == {"page": 0} and len(lines) > 1 and lines[1][1]:
        return ["pagination", "header"] + ["text"] * (len(lines) - 2)
    last = max(where.values(), default=0)
    return ["pagination" if where.get("page") == i else "header" if i in where.values() or i < last else "text" for i in range(len(lines))]


def improved(lines):
    """One volume (kind, text, heading) walked page by page."""
    pages, table = [[]], []
    for kind, text, heading in lines:
        if kind == "pb":
            pages.append([])
        else:
            pages[-1].append((text, heading))
    for first, last, leaves, doubled in FORMULA:
        for c in range(ord(first), ord(last) + 1):
            table += [(chr(c) * (1 + doubled), no) for no in range(1, 2 * leaves + 1)]
    out = []
    for page, rows in enumerate(pages):
        names = roles(rows[:3], page) if len(rows) > 1 else []
        names += ["text"] * (len(rows) - len(names))
        if len(rows) in (1, *range(4, 99)) and page + 1 < len(pages) and numeral(rows[-1][0] or ""):
            names[-1] = "signature"
        g, no = table[page - 1] if 0 < page <= len(table) else (None, None)
        label = g and f"{g}{-(-no // 2)}{'v' if no % 2 == 0 else 'r'}"
        out += [(page, f"{-(-page // 2)}{'r' if page % 2 else 'v'}", g, label, r, t) for r, (t, _) in zip(names, rows)]
    return out


@pytest.mark.parametrize("stretch", [1 << 16, 7])
def test_volumes_equal_a_walk(spark, monkeypatch, stretch):
    """Volumes of all kinds of pages; in one stretch of lines and in many."""
    monkeypatch.setattr(structure, "STRETCH", stretch)
    rng = random.Random(3)
    volumes = {v: [("pb", None, False) if rng.random() < 0.3 else ("l", rng.choice(TEXTS), rng.random() < 0.4) for _ in range(n)] for v, n in ((1, 90), (2, 4), (None, 60), (4, 1))}
    volumes[5] = [("l", "xii.", False), ("pb", None, False), ("l", "iii", True), ("pb", None, False)]
    rows = [(v, k * 3, *line, "more") for v, lines in volumes.items() for k, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "volume int, line_no long, kind string, text string, heading boolean, page string").repartition(5)
    got = {}
    for r in structure.improve(df.drop("page"), FORMULA).orderBy("line_no").collect():
        got.setdefault(r.volume, []).append(tuple(r)[2:])
    assert got == {v: improved(lines) for v, lines in volumes.items() if any(k == "l" for k, *_ in lines)}
    assert structure.improve(df.drop("page").limit(0), FORMULA).count() == 0


def test_headings_take_their_line(spark):
    rows = ["<l>1 <azklein a='b'>Of the</azklein> city</l>", "<l><azgross>big</azgross></l>", "  <pb>", "free <azklein>text</azklein>", "<l></l>", "", "<lg>abbr~", None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, value string")
    got = {r.k: r.value for r in structure.prepare_lines(df, (("~", "en"), ("^<l></l>$", ""))).collect()}
    assert got == {0: "<l><azklein>1 Of the city</azklein></l>", 1: "<l><azgross>big</azgross></l>", 2: "  <pb>", 3: rows[3], 5: "", 6: "<lg>abbren", 7: None}


def located(spark, body, **attrs):
    xml = f'<TEI><div n="1"><p n="2"><gb n="A"/><pb n="1r"/>{body}</p></div></TEI>'
    return [(r.kind, r.text, r.page, r.gathering) for r in extract.extract_tei(spark.createDataFrame([("d", xml)], "docid string, xml string")).orderBy("row_idx").collect()]


def test_headers_in_pairs(spark):
    """A header that goes on over two pages is one row where the later part stands, in the order of reading."""
    left, right = '<l><fw type="header" xml:id="a" next="#b">Of the</fw></l>', '<l><fw type="header" xml:id="b" prev="#a">city</fw></l>'
    pb = '<pb n="1v"/>'
    want = [("main", "one#lb#", 1, "A1r"), ("meta", "Of the#lb#city#lb#", 2, "A1v"), ("main", "two#lb#", 2, "A1v")]
    assert located(spark, f"{left}<l>one</l>{pb}{right}<l>two</l>") == want
    assert located(spark, f"{right}<l>one</l>{pb}{left}<l>two</l>") == want
    assert located(spark, '<l><fw type="header">Alone</fw></l><l>text<fw type="sig">ab</fw></l>') == [("meta", "Alone#lb#", 1, "A1r"), ("main", "text#lb#", 1, "A1r")]
    assert located(spark, left) == []


def test_notes_and_broken_lines(spark):
    note = "<note><quote><l>St.</l><l>Ur<pc type='syllabification'/></l><l>sula</l></quote><quote>prays</quote></note>"
    assert located(spark, note + "<l>a=b<pc type='syllabification'/></l>") == [("meta", "St.#lb#Ursula#lb#prays#lb#", 1, "A1r"), ("main", "ab=", 1, "A1r")]
    chain = "<l>x <seg type='tr' subtype='free' corresp='#p #q' xml:id='s' next='#t'> one</seg></l><l><seg type='tr' xml:id='t' prev='#s' next='#u'>two</seg></l><l><seg type='tr' xml:id='u' prev='#t'>three.</seg> y</l>"
    assert located(spark, chain) == [("main", "x $segstart_s_free_p&q$one#lb#two#lb#three$segend_s$. y#lb#", 1, "A1r")]
    # the last page of a gathering keeps its place
    assert [r[3] for r in located(spark, "<l>a</l><gb n='B'/><pb n='2r'/><l>b</l>")] == ["A1r", "B1r"]


def test_forms_of_markers(spark):
    cases = {
        "a $segstart_1$ b": "a $segstart_1$b",
        "a$segstart_1$b$segend_1$c": "a $segstart_1$b$segend_1$ c",
        "a b.$segend_1$ ": "a b$segend_1$. ",
        "$segstart_1$ a $segend_1$": " $segstart_1$a$segend_1$ ",  # the white space put outside stays
        "a $segend_1$ $segstart_2$ b": "a$segend_1$$segstart_2$b",
        "x (a.)$segend_1$$segend_2$ y": "x (a$segend_1$$segend_2$.) y",
        "nothing here": "nothing here",
    }
    got = {r.t: r.c for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", extract.canonical_segments(F.col("t")).alias("c")).collect()}
    assert got == cases


def test_passages_meet_once(spark):
    """Long, short and reversed passages over many stretches: as all pairs, each once."""
    rng = random.Random(5)
    spans = lambda n: sorted({(i, f"d{rng.randrange(3)}", a, a + rng.choice([-3, 0, 5, 400, 9000])) for i, a in ((rng.randrange(40), rng.randrange(6000)) for _ in range(n))})
    g, t = spans(80), spans(80)
    schema = "match_id int, docid string, start int, end int"
    got = sorted(tuple(r) for r in matches.overlaps(spark.createDataFrame(g, schema), spark.createDataFrame(t, schema)).select("g", "t", "docid", "gs", "ge", "ts", "te").collect())
    assert got == sorted((i, j, d, a, b, x, y) for i, d, a, b in g for j, e, x, y in t if d == e and a <= y and x <= b)


def test_words_over_pages_from_tei(spark):
    """X6 with W4: the mark at the end of a page lets its last word be joined with the next page."""
    xml = '<TEI><div n="1"><p n="2"><pb n="1r"/><l>hier beg</l><pb n="1v"/><l>onnen sij begonnen wel</l></p></div></TEI>'
    rows = extract.extract_tei(spark.createDataFrame([("d", xml)], "docid string, xml string")).withColumnRenamed("docid", "corpus")
    got, _ = drivers.clean_corpus(rows)
    assert [r.text for r in got.orderBy("row_idx").collect()][0].startswith("hier begonnen")
