"""Outputs of detectors that ran elsewhere, read in their formats and scored like passages of our own."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.plans import drivers
from textloom.sources import tables

#: Matches of pairs of passages (document, start, end).
FOUND = [[("a", 0, 9), ("b", 5, 19)], [("a", 30, 49), ("c", 0, 20)], [("b", 100, 120), ("c", 70, 99)]]
GOLD = [("g1", "a", 2, 11), ("g1", "b", 0, 15), ("g2", "b", 101, 110), ("g2", "c", 80, 90), ("g3", "a", 200, 210), ("g3", "c", 300, 310)]


@pytest.fixture
def outputs(tmp_path):
    seed = tmp_path / "seed"
    seed.mkdir()
    hits = lambda m: {"hits": [{"title": "t", "doc_id": d, "original_indices": [s, e]} for d, s, e in m]}
    (seed / "one.json").write_text(json.dumps({"0": hits(FOUND[0])}, indent=1))
    (seed / "two.json").write_text(json.dumps({"0": hits(FOUND[1]), "1": hits(FOUND[2])}))  # the key of another file again
    (seed / "info.json").write_text('{"config": {"word_size": 7}}')
    passages = [{"cluster": k, "id": d, "begin": s, "end": e, "text": "x"} for k, m in enumerate(FOUND) for d, s, e in m]
    (tmp_path / "out.jsonl").write_text("\n".join(map(json.dumps, passages)))
    groups = [{"cid": k, "matches": [p for p in passages if p["cluster"] == k]} for k in range(3)]
    (tmp_path / "out.json").write_text(json.dumps({"clusters": groups}, indent=2))
    side = lambda s, p: {f"{s}_filename": f"/some/where/{p[0]}.txt", f"{s}_start_byte": p[1], f"{s}_end_byte": p[2], f"{s}_passage": "x" * 3}
    (tmp_path / "alignments.jsonl").write_text("\n".join(json.dumps(side("source", m[0]) | side("target", m[1])) for m in FOUND))
    return tmp_path


def test_readers(spark, outputs):
    want = sorted(sorted(m) for m in FOUND)

    def matches(df):
        got = {}
        for r in df.collect():
            got.setdefault(r.cluster, []).append((r.docid, r.start, r.end))
        return sorted(map(sorted, got.values()))

    assert matches(tables.read_clusters(spark, str(outputs / "seed"))) == want
    assert matches(tables.read_passages(spark, str(outputs / "out.jsonl"))) == want
    assert matches(tables.read_passages(spark, str(outputs / "out.json"), grouped=True)) == want
    assert matches(tables.read_alignments(spark, str(outputs / "alignments.jsonl"))) == want
    short = sorted(sorted((d, s, s + 3) for d, s, _ in m) for m in FOUND)
    assert matches(tables.read_alignments(spark, str(outputs / "alignments.jsonl"), by_passage=True)) == short


def test_scores_of_three_formats(spark, outputs):
    """Each format gives the scores of the same passages, which are known by hand."""
    gold = spark.createDataFrame(GOLD, "match_id string, docid string, start long, end long")
    done = drivers.read_runs(gold, [("seed", "norm/full", str(outputs / "seed")), ("gram", "unnorm-lem/sentences", str(outputs / "out.jsonl")), ("window", "unnorm/full", str(outputs / "alignments.jsonl"))])
    rows = drivers.score_runs(gold, done).orderBy("run_no").collect()
    assert [(r.tool, r.norm, r.lem, r.testmatch_no, r.goldmatch_no) for r in rows] == [("seed", 1, 0, 3, 2), ("gram", 0, 1, 3, 2), ("window", 0, 0, 3, 2)]
    # gold characters covered: 8 of 10, 11 of 16, 10 of 10, 11 of 11; found ones: 8 of 10, 11 of 15, 10 of 21, 11 of 30
    want = (round(2 / 3, 6), round(2 / 3, 6), round(40 / 47, 6), round(40 / 76, 6), 1.0, 1.0)
    assert {(r.r_m, r.p_m, r.r_ch, r.p_ch, r.r_cl, r.p_cl) for r in rows} == {want}
