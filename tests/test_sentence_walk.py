"""Sentences of a paragraph are folded line by line, whatever the batches."""

from itertools import count

from textloom.operators import segment


def test_a_fold_gives_sentences_before_its_lines_end():
    """Before, a fold held all sentences of a paragraph, and Python all its lines."""
    seen = count()
    lines = ((f"sentence number {next(seen)} of many#SEND#", 1) for _ in range(1000))
    first = next(iter(segment._folded(lines, 4, "join")))
    assert first == ["sentence number 0 of many", 1] and next(seen) < 20


def test_paragraphs_go_on_across_batches(spark, monkeypatch):
    monkeypatch.setattr(segment, "SEGMENTS", 3)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    lines = ["one two three four#SEND# five", "six#SEND#", "seven eight nine", "ten=", "eleven#SEND# a b c d e#SEND#", "", "f g h#SEND#"]
    rows = spark.createDataFrame([(c, None, "1", i, i, t) for c in ("a", "b", None) for i, t in enumerate(lines)], "corpus string, bookpart string, paragraph string, row_idx int, page int, text string")
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        got = segment.sentences(rows).orderBy("corpus", "seg_idx").collect()
    finally:
        spark.conf.set(key, before)
    want = list(segment._folded([(t, i) for i, t in enumerate(lines)], 4, "join"))
    assert len(want) > 2 and [[r.text, r.page] for r in got] == want * 3 and [r.seg_idx for r in got] == [*range(len(want))] * 3
