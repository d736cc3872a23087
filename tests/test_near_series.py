"""Detection where one series is large: the same results, without shuffling its grams."""

import random

from pyspark.sql import functions as F

from textloom.operators import detect


def docs(spark, seed=5):
    rnd = random.Random(seed)
    words = ["häuser", "laufen", "Kinder", "auen", "freundlichkeit", "12", "x", "über", "straße", "gehst", "bauer", "eis"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 40))) for _ in range(30)]
    rows = [("d", f"d{i}", t) for i, t in enumerate(texts)] + [("b", f"b{i}", f"{texts[i][:60]} {texts[i + 9][:40]}") for i in range(4)] + [("d", "none", None)]
    return spark.createDataFrame(rows, "series string, docid string, text string")


def test_rows_of_grams_equal_located_grams(spark):
    d = docs(spark)
    for n, gap, ordered in ((3, 0, True), (3, 1, False), (2, 2, True)):
        for how in ({}, {"stem": True, "fold_numbers": True}):
            want = detect.located_grams(detect.located_tokens(d, **how), n, gap, ordered)
            got = detect.gram_rows(detect.token_rows(d, **how), n, gap, ordered).select("series", "docid", F.explode("g").alias("g")).select("series", "docid", "g.*")
            names = ["series", "docid", "pos", "gram", "start", "end"]
            assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))


def test_large_series_gives_the_same_matches(spark):
    d = docs(spark)
    assert detect.large_series(d) == "d"
    for grams in (detect.word_grams(d, 2), detect.char_grams(d, 9), detect.gram_rows(detect.token_rows(d), 3).select("series", "docid", F.explode("g").alias("g")).select("series", "docid", "g.*")):
        want = detect.gram_matches(grams)
        got = detect.gram_matches(grams, large="d")
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count()


def test_only_grams_of_the_small_series_are_kept(spark):
    """Before, the grams of every document were shuffled."""
    d = docs(spark)
    grams = detect.char_grams(d, 9)
    near = detect.near_series(grams, F.col("series") != "d")
    known = {r.gram for r in grams.where("series = 'b'").collect()}
    assert {r.gram for r in near.collect()} == known and near.count() < grams.count()


def test_more_grams_than_can_be_sent(spark, monkeypatch):
    d = docs(spark)
    how = {"ngram": 3, "window": 5, "in_docs": 2, "in_window": 2, "minimum": 2, "max_gap": 5}
    rows = lambda **more: sorted(map(tuple, detect.window_alignment(d, "b", **how, **more).drop("banal").collect()))
    want = rows()
    assert want and rows(tell_banal=False) == want
    monkeypatch.setattr(detect, "KNOWN", 3)
    assert rows() == want


def test_frequency_is_a_quantile(spark):
    texts = ["aa bb cc", "aa bb cc dd", "aa bb cc ee", "bb cc dd"]
    d = spark.createDataFrame([("s", str(i), t) for i, t in enumerate(texts)], "series string, docid string, text string")
    per_doc = detect.gram_rows(detect.token_rows(d), 2)  # aa bb 3, bb cc 4, cc dd 2, cc ee 1
    assert [detect._frequency(per_doc, q) for q in (0.25, 0.5, 0.75, 0.9)] == [1, 2, 3, 4]
