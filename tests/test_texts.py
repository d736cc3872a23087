"""Several texts in a file, parentheses segmented again, spellings of annotated tokens."""

from textloom.operators import extract, segment, similarity, wordgraph
from textloom.plans import drivers
from textloom.sources import tables

TEI = """<TEI xml:id="{id}" xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><bibl><citedRange from="{at}"/></bibl></teiHeader>
<text><body><div n="b1"><p n="p1"><l>first line</l><pb n="{fol}"/><l>second</l><l>line</l></p></div></body></text></TEI>"""


def test_gold_texts_of_one_file(spark):
    """Each text goes on from the page, folio and gathering of its citation."""
    file = "<teiCorpus xmlns='http://www.tei-c.org/ns/1.0'>" + TEI.format(id="one", at="7-4r-B-3", fol="4v") + TEI.format(id="two", at="20-11v-D-6", fol="12r") + "</teiCorpus>"
    docs = spark.createDataFrame([("f", file), ("broken", file[: file.rindex("<TEI")] + "<TEI><unclosed>"), ("none", None), ("plain", "<teiCorpus><TEI><text/></TEI></teiCorpus>")], "docid string, xml string")
    rows = [(r.docid, r.text, r.page, r.fol, r.gathering) for r in extract.extract_gold(docs.where("docid = 'f'")).orderBy("docid", "row_idx").collect()]
    assert rows == [("one", "first line#lb#", 7, "4r", "B2r"), ("one", "second#lb#line#lb#", 8, "4v", "B2v"), ("two", "first line#lb#", 20, "11v", "D3v"), ("two", "second#lb#line#lb#", 21, "12r", "D4r")]
    assert {r.docid for r in extract.extract_gold(docs).collect()} == {"one", "two"}
    assert extract.extract_gold(docs.where("docid = 'broken'")).count() == 2


def test_parentheses_are_segmented_again(spark):
    text = "this is before it #INSTART#here stand four words#SEND#and some four more words#INEND# and it goes on here#SEND#the last plain sentence stands#SEND#"
    rows = spark.createDataFrame([("c", "b", "p", 0, 3, text), ("c", "b", "q", 1, 4, "no marks in this one#SEND#"), ("c", "b", "r", 2, 5, None)], "corpus string, bookpart string, paragraph string, row_idx int, page int, text string")
    got = {}
    for r in segment.nested_sentences(rows).orderBy("paragraph", "seg_idx").collect():
        got.setdefault(r.paragraph, []).append((r.seg_idx, r.page, r.text))
    assert got["p"] == [
        (0, 3, "here stand four words"), (1, 3, "and some four more words"),  # the parenthesis
        (2, 3, "this is before it here stand four words"), (3, 3, "and some four more words and it goes on here"),  # the whole
        (4, 3, "this is before it and it goes on here"),  # the rest
        (5, 3, "the last plain sentence stands"),
    ]
    assert got["q"] == [(0, 4, "no marks in this one")] and "r" not in got


def test_spellings(spark):
    tokens = [
        (0, "hus", "hus", "haus"), (1, "huͦs", "hus", "haus"), (2, "HUS", "x", "hut"), (3, "uͮn", "un", "un"), (4, "guͤt", "gut", "gut"), (5, "gut", "b", "bad"), (6, "vii", "--", "--"), (7, "abc", "--", "x"), (8, "a1", "q", "q"), (9, "gut", "b", "bad"),
        (10, "tie", "b", "b"), (11, "tie", "a", "a"), (12, "uͮx", "--", "--"),
    ]
    got = {r.form: r.lemma for r in wordgraph.reference_lemmas(spark.createDataFrame(tokens, "ord int, form string, simple string, lemma string")).collect()}
    assert got == {"hus": "haus", "huos": "haus", "un": "un", "vn": "un", "uun": "un", "uvn": "un", "gut": "bad", "guet": "gut", "vii": "1234", "tie": "b", "ux": "1234"}


def test_rules_and_scores_from_files(spark, tmp_path):
    """Rule tables and a scoring file as inputs of the cleaning and the similarity."""
    (tmp_path / "case.csv").write_text('desc,regex,replace\nbig v,V(?=n),U\n"quoted, with comma","(\\d),(\\d)",\\1.\\2\n', encoding="utf-8")
    (tmp_path / "low.csv").write_text("desc,regex,replace\nsharp,ß,ss\nthen,ss$,s\nmark,\\|\\|,\n", encoding="utf-8")
    (tmp_path / "pre.csv").write_text("desc,regex\nup,(?<!\\w)[uv]p\\s\\w+\n", encoding="utf-8")
    (tmp_path / "scoring.json").write_text('{"scoring": {"name": "x", "pairscores": {"1": [["i", "j"]], "-0.5": [["k", "l"]]}, "doublescores": {"0.25": ["a", "e"]}}}')
    at = lambda n: str(tmp_path / n)
    how = drivers.Preparation.read(spark, case_rules=at("case.csv"), rules=at("low.csv"), prefixes=at("pre.csv"), min_words=3)
    assert how.case_rules == (("V(?=n)", "U"), (r"(\d),(\d)", r"\1.\2")) and how.rules == (("ß", "ss"), ("ss$", "s"), (r"\|\|", "")) and how.prefixes == ("[uv]p",) and how.min_words == 3
    rows = spark.createDataFrame([("a", 0, "", "", "Vnd|| vp staßen"), ("a", 1, "", "", "vpstassen here naß")], "corpus string, row_idx int, bookpart string, paragraph string, text string")
    got, _ = drivers.clean_corpus(rows, how)
    assert [r.text for r in got.orderBy("row_idx").collect()] == ["und vpstassen", "vpstassen here nas"]
    sm = similarity.matrix(*tables.read_scoring(spark, at("scoring.json")))
    assert sm[8, 9] == sm[9, 8] == 1 and sm[10, 11] == -0.5 and sm[0, 4] == sm[4, 0] == 0.25 and sm[0, 0] == 1 and sm[0, 1] == -1
    pairs = spark.createDataFrame([("ja", "ie")], "x string, y string")
    assert similarity.similarity(pairs, sm).first().sim == 1.25
