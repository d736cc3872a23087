"""Tokens are numbered where they are cut."""

from textloom.plans import catalogue


def test_located_tokens_query_shuffles_no_token(spark, tmp_path):
    """Before, every token went through a shuffle to be numbered."""
    spark.createDataFrame([(k, f"Ab, cd {k} e fg") for k in range(50)], "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "É x-yz")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = catalogue.located_tokens(spark, str(tmp_path))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r.pos, r.start, r.end) for r in df.where("docid = 'd12'").orderBy("pos").collect()] == [(0, 0, 1), (1, 4, 5), (2, 7, 8), (3, 12, 13)]
