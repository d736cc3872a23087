import re

from pyspark.sql import functions as F
from pytest import approx

from textloom.operators import clean, detect, extract, matches, segment, vocab, wordgraph


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("r")).first()[0]


def test_rules_equal_python_re(spark):
    rules = [(r"(?<!\w)[uv]p(?!\w)", "up"), (r"g(?!\w)", "k"), (r"(?<!\w)(a)(b)", r"\2\1"), (r"\s+", " ")]
    text = "vp tagü tag abc  xab ab"
    want = text
    for r, s in rules:
        want = re.sub(r, s, want)
    assert one(spark, text, lambda c: clean.fold(c, rules)) == want


def test_markers_and_plain(spark):
    assert one(spark, "a. b (c) #lb# d", clean.mark_boundaries) == "a#SEND# b #INSTART#c#INEND# #lb# d"
    assert one(spark, "a#SEND#b-c $segstart_x-1$d$segend_x-1$", clean.plain) == "a b c $segstart_x-1$d$segend_x-1$"


def test_numbers(spark):
    got = {w: one(spark, w, clean.is_number) for w in ("xiiii", "vil", "im", "iim", "vill", "mcm", "a")}
    assert got == {"xiiii": True, "vil": False, "im": False, "iim": False, "vill": False, "mcm": True, "a": False}


def test_join_rules(spark):
    f = spark.createDataFrame([("abcdef", 5), ("abc", 2), ("xy", 1)], "word string, globfreq long")
    p = spark.createDataFrame([("abc", "def"), ("qq", "rr"), ("ab", "cdef"), ("abc", "xy"), ("abc", "q")], "t1 string, t2 string")
    got = {(r.t1, r.t2): r.is_join for r in vocab.decide(p, f).collect()}
    assert got == {("abc", "def"): True, ("qq", "rr"): False, ("ab", "cdef"): True, ("abc", "xy"): False, ("abc", "q"): True}


def test_line_end_join(spark):
    rows = spark.createDataFrame([(1, "the ab #lb# cdef qq#lb#rr")], "i int, text string")
    f = spark.createDataFrame([("abcdef", 5)], "word string, globfreq long")
    assert vocab.join_line_ends(rows, f).first().text == "the abcdef qq rr"


def test_page_break_join(spark):
    rows = spark.createDataFrame([("c", "", "", 1, "we are bro="), ("c", "", "", 2, "ken now"), ("c", "", "", 3, "end")], "corpus string, bookpart string, paragraph string, row_idx int, text string")
    f = spark.createDataFrame([("x", 1)], "word string, globfreq long")
    assert [r.text for r in vocab.join_page_breaks(rows, f).orderBy("row_idx").collect()] == ["we are broken", "now", "end"]


def test_sentences(spark):
    rows = spark.createDataFrame([("c", "", "", 1, "one two three four#SEND# five six seven#SEND# eight nine ten", 1), ("c", "", "", 2, "eleven twelve#SEND#", 2)], "corpus string, bookpart string, paragraph string, row_idx int, text string, page int")
    flat = " ".join(r.text for r in segment.sentences(rows).orderBy("seg_idx").collect())
    assert set(flat.split()) == set("one two three four five six seven eight nine ten eleven twelve".split())


def test_segments_and_gold(spark):
    rows = spark.createDataFrame([("a", 1, "ab$segstart_1$cd$segend_1$ef"), ("b", 1, "x$segstart_2_literal_1$y"), ("b", 2, "z$segend_2$w")], "docid string, row_idx int, text string")
    seg = matches.parse_segments(rows)
    got = sorted((r.docid, r.seg, r.start, r.end, r.text) for r in seg.collect())
    assert got == [("a", "1", 2, 3, "cd"), ("b", "2", 0, 0, "z"), ("b", "2", 1, 1, "y")]
    assert {r.docid for r in matches.gold_matches(seg).collect()} == {"a", "b"}


def test_identity_scores(spark):
    g = spark.createDataFrame([(1, "a", 0, 9), (1, "b", 5, 9), (2, "c", 0, 3), (2, "a", 20, 30)], "match_id long, docid string, start long, end long")
    for f in (matches.score_matches, matches.score_characters, matches.score_clusters):
        assert tuple(f(g, g).first()) == (1.0, 1.0, 1.0)
    lone = spark.createDataFrame([(1, "a", 0, 9)], "match_id long, docid string, start long, end long")
    assert matches.identical(g, lone).count() == 0
    assert tuple(matches.score_matches(g, g.limit(0)).first()) == (0.0, 0.0, 0.0)


def test_characters_inclusive(spark):
    s = "match_id long, docid string, start long, end long"
    g, t = spark.createDataFrame([(1, "d", 0, 9), (1, "e", 0, 0)], s), spark.createDataFrame([(1, "d", 5, 14), (1, "e", 0, 0)], s)
    assert matches.score_characters(g, t).first().r == approx(6 / 11, abs=1e-6)


def test_graph(spark):
    nodes = spark.createDataFrame([(1, "aaaa"), (2, "aaab"), (3, "aaac"), (4, "zzzz")], "id long, form string")
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8)], "src long, dst long, weight double")
    m = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 4)], "com_id string, id long")
    assert {r.com_id: round(r.density, 3) for r in wordgraph.density(m, edges).collect()} == {"x": 0.667, "y": 1.0}
    assert [r.form for r in wordgraph.isolates(nodes, edges).collect()] == ["zzzz"]
    assert {r.id: r.component for r in wordgraph.connected(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    members = wordgraph.dense_communities(nodes, edges)
    assert sorted(r.id for r in members.collect()) == [1, 2, 3, 4]
    assert {r.com_id: r.lemma for r in wordgraph.representative(m, nodes, edges).collect()} == {"x": "aaaa", "y": "zzzz"}


def test_planted_reuse_is_found(spark):
    shared = "the quick brown fox jumps over the lazy dog and runs far away into the dark green forest"
    docs = spark.createDataFrame([("a", "a1", "some words before " + shared + " and some after it"), ("b", "b1", "quite another start here " + shared + " with a different end"), ("b", "b2", "nothing of that kind stands in this text at all")], "series string, docid string, text string")
    for found in (detect.gram_alignment(docs, n=9, min_match=5, min_align=40), detect.seed_and_extend(docs, word_size=9, min_length=40)):
        rows = found.collect()
        assert {r.docid for r in rows} == {"a1", "b1"} and len({r.cluster for r in rows}) == 1
    assert detect.window_alignment(docs, "a", ngram=3, in_docs=4).count() == 1


def test_smith_waterman():
    s = detect.smith_waterman("xxabcdefyy", "zabcdefz", 1, 1, 1, 10)
    assert s == (6.0, 2, 8, 1, 7)


def test_tei(spark):
    xml = '<TEI><div n="1"><p n="2"><gb n="A"/><pb n="1r"/><l>one <choice><orig>x</orig><reg>two</reg></choice></l><l>three bro<pc type="syllabification"/></l><l>ken</l><pb n="1v"/><l>last</l></p></div></TEI>'
    rows = extract.extract_tei(spark.createDataFrame([("d", xml), ("bad", "<x"), ("none", None)], "docid string, xml string")).orderBy("row_idx").collect()
    assert [(r.text, r.page, r.fol, r.gathering) for r in rows] == [("one two#lb#three broken#lb#", 1, "1r", "A1r"), ("last#lb#", 2, "1v", "A1v")]
    assert extract.gathering_label("A", 3) == "A2r" and extract.gathering_label("A", 4) == "A2v"


def test_grid(spark):
    full = matches.grid(spark, ngram=[3, 4], gap=[0, 5], window=[5], minimum=[2, 3], in_docs=[2, 3], in_window=[2, 3], max_gap=[2, 10])
    assert full.count() == 64 and matches.prune_grid(full).count() == 4
