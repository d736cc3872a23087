"""Registered queries take whole tables."""

from textloom.plans import catalogue


def documents(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_rare_and_short_forms_are_nodes(spark, tmp_path):
    d = documents(spark, tmp_path, ["vnd und", "koninck coninck"])
    assert sorted(r.weight for r in catalogue.QUERIES["word_edges"](spark, d).collect()) == [1.0, 1.0]
    assert {r.x for r in catalogue.QUERIES["word_similarity"](spark, d).collect()} == {"vnd", "und", "koninck", "coninck"}
    lemmas = {r.form: r.lemma for r in catalogue.QUERIES["pseudo_lemmas"](spark, d).collect()}
    assert lemmas["vnd"] == lemmas["und"] and lemmas["koninck"] == lemmas["coninck"]


def test_texts_without_insertions_stay(spark, tmp_path):
    d = documents(spark, tmp_path, ["no  insertion", "one (two) three"])
    got = sorted((r.doc_id, r.text) for r in catalogue.QUERIES["insertions"](spark, d).collect())
    assert got == [(0, "no  insertion"), (1, "one three"), (1, "one two three"), (1, "two")]
