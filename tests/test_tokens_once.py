"""Several window runs over one input cut it into tokens once."""

from textloom.operators import detect
from textloom.plans import drivers

TEXT = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"


def test_runs_share_tokens(spark, monkeypatch):
    """Before, every run cut and stemmed all texts again."""
    calls, cut = [], detect.token_rows
    monkeypatch.setattr(detect, "token_rows", lambda *a, **k: calls.append(a[1:]) or cut(*a, **k))
    docs = spark.createDataFrame([("a", "a1", f"one two {TEXT} three"), ("b", "b1", f"{TEXT} four five"), ("b", "b2", None)], "series string, docid string, text string")
    params = {"ngram": 3, "in_docs": 2, "in_window": 2, "minimum": 2, "max_gap": 5}
    wanted = sorted(map(tuple, drivers.detect_passages("window", docs, "a", **params, window=5).select("docid", "start", "end").collect()))
    assert [w[0] for w in wanted] == ["a1", "b1"]
    gold = spark.createDataFrame([("g", "a1", 8, 20)], "match_id string, docid string, start long, end long")
    calls.clear()
    grid = [("window", {**params, "window": w}) for w in (5, 10)] + [("window", {**params, "window": 5, "stem": False})]
    done = drivers.evaluate_runs({"unnorm/full": docs}, gold, grid)
    assert sorted(calls) == [(2, False, True), (2, True, True)]
    assert sorted(map(tuple, done.passages.where("run_no = 0").select("docid", "start", "end").collect())) == wanted
    calls.clear()
    ready = detect.tokenised(docs)
    again = drivers.evaluate_runs({"unnorm/full": ready}, gold, grid[:2])
    assert len(calls) == 1 and detect.large_series(ready) == detect.large_series(docs)
    assert sorted(map(tuple, again.passages.where("run_no = 0").select("docid", "start", "end").collect())) == wanted
