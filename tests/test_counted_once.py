"""Words and pairs of words: what is read and shuffled, and the same results."""

from textloom.operators import detect, vocab
from textloom.plans import catalogue

ROWS = [(1, "aa bb cc. aa", "x"), (2, "AA bb", None), (3, "", "x"), (4, None, "y"), (5, "single", "y")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frequencies_equal_totals(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    want = {tuple(r) for r in vocab.totals(vocab.vocabulary(rows, "lang")).collect()}
    got = vocab.frequencies(rows)
    assert {tuple(r) for r in got.collect()} == want == {("aa", 3), ("bb", 2), ("cc", 1), ("single", 1)}
    assert plan(vocab.frequencies(rows)).count("Exchange") == 1


def test_pairs_are_cut_once(spark, tmp_path):
    """Before, a filter by size cut every text twice, and pairs were joined and split again."""
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue._bigrams(spark, str(tmp_path))
    assert "split(" not in plan(got) and "Filter (" not in plan(got)
    assert {tuple(r) for r in got.collect()} == {("aa", "bb"), ("bb", "cc"), ("cc", "aa")}


def test_edges_read_documents_once(spark, tmp_path):
    """Before, every join of the nodes counted the words of all documents again."""
    spark.createDataFrame([(1, "word words wor", "x")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    n = catalogue.tables.written(catalogue._nodes(spark, str(tmp_path)), "nodes")
    assert "documents.parquet" not in plan(catalogue._edges(spark, str(tmp_path), n))
    got = {(r.fa, r.fb) for r in catalogue.edges_from_csv(spark, str(tmp_path)).collect()}
    assert got == {("wor", "word"), ("word", "words")}


def test_grams_of_a_long_series_do_not_reach_the_document_frequency(spark):
    """gram_alignment: the limit of documents counts all of them, though grams of one series have gone before."""
    text = "abcdefghijklmnopqrstuvwxyz0123456789" * 2
    rows = [("b", "b1", text)] + [("d", f"d{i}", text) for i in range(4)]
    docs = spark.createDataFrame(rows, "series string, docid string, text string")
    assert detect.gram_alignment(docs, n=9, max_df=4).count() == 0 and detect.gram_alignment(docs, n=9, max_df=5).count() > 0
