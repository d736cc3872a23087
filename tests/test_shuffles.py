"""What is shuffled, by plan."""

import re

from textloom.operators import detect
from textloom.plans import catalogue


def exchanges(df):
    return re.findall(r"Exchange (hashpartitioning\(.*)", df._jdf.queryExecution().executedPlan().toString())


def test_grams_are_shuffled_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f"), (2, "x a b c d e"), (2, "a b c d e")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = catalogue.ngram_df(spark, str(tmp_path))
    assert len(exchanges(df)) == 1 and [tuple(r) for r in df.collect()] == [("a b c d e", 2)]


def test_tokens_are_shuffled_without_their_pieces(spark):
    docs = spark.createDataFrame([("s", "1", "Ab, cd")], "series string, docid string, text string")
    df = detect.located_tokens(docs)
    plan = df._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning") :].split("\n")[1]
    assert "AS tok" in below and not re.search(r"\bpiece#\d+,|\braw#\d+,", below)
    assert [(r.tok, r.start, r.end) for r in df.orderBy("pos").collect()] == [("ab", 0, 1), ("cd", 4, 5)]
