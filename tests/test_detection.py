"""The registered detectors over small tables with planted passages."""

import random
from math import exp, log

from textloom.operators import detect
from textloom.plans import catalogue


def tables(spark, path, docs, bench):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_seeds_find_short_and_edited_passages(spark, tmp_path):
    edited = ("quick brown vox jumped over a lazy dog", "quick brown fox jumped ower a lazy dog")
    d = tables(spark, tmp_path, [(1, f"zzzz {edited[0]} 0000"), (2, "nothing stands here")], [(1, f"1111 {edited[1]} yyyy")])
    rows = catalogue.QUERIES["seed_and_extend"](spark, d).collect()
    assert {r.docid for r in rows} == {"d1", "b1"} and len({r.cluster for r in rows}) == 1


def test_gram_anchors_float(spark, tmp_path):
    """No anchor starts at a word: the words of the passage are far longer than the grams it shares."""
    long = "abcdefghijklmnopqrstuvwxyzqponmlkjihgfedcbzyxwvutsrqponmabcdefghijkl"
    d = tables(spark, tmp_path, [(1, f"un{long} end")], [(1, f"re{long} stop")])
    assert {r.docid for r in catalogue.QUERIES["gram_alignment"](spark, d).collect()} == {"d1", "b1"}


def test_seeds_of_common_passages_stay(spark):
    """A passage of more than 100 documents, some of them copies; the parts around it differ."""
    rnd = random.Random(8)
    own = lambda abc: "".join(rnd.choice(abc) for _ in range(50))
    text = "the passage that stands in very many documents of the table"
    texts = [own("0123456789") + text + own("0123456789") for _ in range(120)]
    rows = [("d", f"d{i}", t) for i, t in enumerate([*texts, *texts[:20]])] + [("b", "b1", own("!?-+*/") + text + own("!?-+*/"))]
    got = detect.seed_and_extend(spark.createDataFrame(rows, "series string, docid string, text string"), word_size=7, min_length=15).collect()
    assert {(r.docid, r.start, r.end) for r in got} == {(i, 50, 49 + len(text)) for _, i, _ in rows} and len({r.cluster for r in got}) == 1


def test_seeds_equal_brute_force(spark):
    rnd = random.Random(3)
    texts = {(s, f"{s}{i}"): "".join(rnd.choice("ab") for _ in range(90)) for s in "xyz" for i in range(3)}
    want, k = {}, 6
    for (s, i), x in texts.items():
        for (t, j), y in texts.items():
            if s >= t:
                continue
            for p in range(len(x)):
                for q in range(len(y)):
                    n = next((c for c in range(len(x)) if p + c >= len(x) or q + c >= len(y) or x[p + c] != y[q + c]), 0)
                    if n < k or (p and q and x[p - 1] == y[q - 1]):
                        continue
                    ends, total = [], n
                    for at, step in ((p, -1), (p + n - 1, 1)):
                        score = best = 0
                        far = at
                        while 0 <= at + step < len(x) and 0 <= at + step - p + q < len(y) and score > best - 5:
                            at += step
                            score += 1 if x[at] == y[at - p + q] else -1
                            if score > best:
                                best, far = score, at
                        ends.append(far)
                        total += best
                    if 0.3 * len(x) * len(y) * exp(-log(3) * total) <= 0.001:
                        for d, o in ((i, 0), (j, q - p)):
                            want.setdefault(d, set()).update(range(ends[0] + o, ends[1] + o + 1))
    got: dict = {}
    rows = [(s, i, t) for (s, i), t in texts.items()]
    for r in detect.seed_and_extend(spark.createDataFrame(rows, "series string, docid string, text string"), word_size=k).collect():
        got.setdefault(r.docid, set()).update(range(r.start, r.end + 1))
    assert want and got == want
