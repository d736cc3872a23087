"""Tokens and grams in arrays: the same as in columns, without a shuffle."""

import random

from pyspark.sql import functions as F

from textloom.operators import detect


def test_stems_of_words_equal_those_of_columns(spark):
    rnd = random.Random(3)
    parts = ["auf", "bäu", "eyu", "uyu", "straß", "nis", "kind", "schön", "frei", "ab", "quel", "x", "ñ", "derb"]
    ends = ["", "e", "en", "er", "ern", "em", "es", "s", "st", "est", "end", "ung", "ig", "ik", "isch", "lich", "heit", "keit", "lichkeit", "igkeit", "erlich", "enheit", "nisse", "igung", "eig"]
    words = sorted({"".join(rnd.choices(parts, k=rnd.randint(0, 3))) + rnd.choice(ends) + rnd.choice(ends) for _ in range(4000)} - {""})
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", detect.german_stem(F.col("w")).alias("s")).collect()
    assert {r.w: (r.s, detect.stemmed(r.w)) for r in got if r.s != detect.stemmed(r.w)} == {}


def test_frequencies_in_arrays(spark, monkeypatch):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choices(["aa", "bb", "cc", "dd", "ee", "ff"], k=rnd.randint(0, 30))) for _ in range(40)]
    tokens = detect.token_rows(spark.createDataFrame([("s", str(i), t) for i, t in enumerate(texts)], "series string, docid string, text string"))
    monkeypatch.setattr(detect, "COUNTED", 100)
    monkeypatch.setattr(detect, "WAITING", 50)
    for n, gap, ordered in ((2, 0, True), (3, 1, False)):
        each = detect.gram_rows(tokens, n, gap, ordered).select("docid", F.explode("g.gram").alias("gram")).distinct().groupBy("gram").agg(F.count("*").alias("df"))
        want = sorted(map(tuple, each.groupBy("df").agg(F.count("*")).collect()))
        assert sorted(map(tuple, detect._frequencies(tokens, n, gap, ordered).collect())) == want


def test_near_grams_equal_near_series(spark):
    rnd = random.Random(9)
    text = lambda: " ".join(rnd.choices(["aa", "bb", "cc", "dd", "ee", "ff", "gg"], k=rnd.randint(0, 30)))
    tokens = detect.token_rows(spark.createDataFrame([("d" if i else "b", str(i), text()) for i in range(40)], "series string, docid string, text string"))
    for n, gap, ordered in ((2, 0, True), (3, 1, False), (3, 2, True)):
        grams = detect.gram_rows(tokens, n, gap, ordered).select("series", "docid", F.explode("g").alias("g")).select("series", "docid", "g.*")
        want = detect.near_series(grams, F.col("series") == "b")
        got = detect.near_grams(tokens, F.col("series") == "b", n, gap, ordered)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())) and got.count()
    none = detect.near_grams(tokens, F.col("series") == "x", 2, 0, True)
    assert none is not None and none.count() == 0
