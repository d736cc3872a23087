"""Word joining, snapshot and in order, against a plain Python fold."""

import random
import re

import pytest

from textloom.operators import vocab
from textloom.plans import drivers

WORDS = ["be", "gonnen", "begonnen", "onnen", "vii", "vil", "a", "b", "ab", "stat", "stadt", "ver", "loren", "verloren", "xi", "lo", "ren", "im"]
RULES = ((("W", "v"),), (("dt", "t"), ("th", "t")))
FREQS = {"begonnen": 9, "onnen": 1, "ab": 1, "verloren": 3, "ver": 1, "stat": 2, "loren": 4, "vii": 2, "be": 5, "lo": 1, "bestat": 2, "a": 7}


def normal(text, rules):
    for r in rules[0]:
        text = re.sub(*r, text)
    text = text.lower()
    for r in rules[1]:
        text = re.sub(*r, text)
    return text


def is_number(w):
    return re.fullmatch("[ijvxlcdmIJVXLCDM]+", w) and not re.match("[vV][ijIJ]{1,2}[lL][lL]?$", w) and not re.match("[ijIJ]{1,2}[mM]", w)


def by_hand(texts, freqs, rules, prefixes, mutate):
    """Rows in order, candidates in order; with mutate the frequencies follow each decision."""
    freqs = dict(freqs)

    def one(t1, t2, prefix, counted):
        whole, parts = normal(t1 + t2, rules), normal(t1 + " " + t2, rules).split()
        a, b = parts[:2] if len(parts) > 1 else (t1, t2)
        j, fa, fb = freqs.get(whole.lower(), 0), freqs.get(a.lower(), 0), freqs.get(b.lower(), 0)
        fa, fb = max(0, fa - counted), max(0, fb - counted)
        if len(parts) < 2:
            yes = True
        elif prefix:
            yes = j > 0 and len(b) > 3 and fb < j
        else:
            yes = {
                (0, 0, 0): False, (1, 0, 0): True, (0, 1, 1): False, (1, 1, 0): not is_number(a), (1, 0, 1): not is_number(b),
                (0, 1, 0): not (is_number(a) or is_number(b)) and len(b) < 3, (0, 0, 1): not (is_number(a) or is_number(b)) and len(a) < 3,
                (1, 1, 1): not (is_number(a) or is_number(b)) and (j >= 2 or fa == 1 or fb == 1),
            }[int(j > 0), int(fa > 0), int(fb > 0)]
        if mutate:
            if yes:
                freqs[whole.lower()] = freqs.get(whole.lower(), 0) + 1
            for w in (a.lower(), b.lower()):
                if yes and counted:
                    freqs[w] = freqs.get(w, 0) - 1
                if not yes and not counted:
                    freqs[w] = freqs.get(w, 0) + 1
        return whole if yes else " ".join(parts)

    def each(text, regex, split, prefix, counted):
        found = re.findall(regex, text)
        for c in found if mutate else dict.fromkeys(found):
            r = one(*c.split(split)[:2], prefix, counted)
            text = re.sub(r"(?<!\w)" + c + r"(?!\w)", lambda m: r, text)
        return text

    out = []
    for t in texts:
        t = re.sub(r"\s*#lb#\s*", "#lb#", t)
        while re.search(r"\w#lb#\w", t):
            t = each(t, r"\w+#lb#\w+", "#lb#", False, 0)
        out.append(each(t, r"(?<!\w)(?:" + "|".join(prefixes) + r") \w+", " ", True, 1))
    return out, {w: n - FREQS.get(w, 0) for w, n in freqs.items() if n != FREQS.get(w, 0)}


def made(rnd, n):
    return ["".join(rnd.choice(WORDS + ["Stadt", "Wer"]) + rnd.choice([" ", "#lb#", " #lb# ", " ", ". ", "x "]) for _ in range(rnd.randint(1, 14))).strip() for _ in range(n)]


def test_prefixes_between_words(spark):
    freqs = spark.createDataFrame([("begonnen", 9), ("onnen", 1)], "word string, globfreq long")
    rows = spark.createDataFrame([(0, "obe gonnen be gonnen"), (1, "be gonnenx be gonnen")], "k int, text string")
    assert [r.text for r in vocab.join_prefixes(rows, freqs, ["be"]).orderBy("k").collect()] == ["obe gonnen begonnen", "be gonnenx begonnen"]


@pytest.mark.parametrize("rules", [((), ()), RULES])
def test_snapshot_equals_fold(spark, rules):
    texts = made(random.Random(1), 150)
    freqs = spark.createDataFrame(list(FREQS.items()), "word string, globfreq long")
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = vocab.join_prefixes(vocab.join_line_ends(rows, freqs, rules), freqs, ["be", "ver"], rules)
    assert [r.text for r in got.orderBy("k").collect()] == by_hand(texts, FREQS, rules, ["be", "ver"], False)[0]


@pytest.mark.parametrize("rules", [((), ()), RULES])
def test_order_equals_fold(spark, rules):
    corpora = {c: made(random.Random(c), 60) for c in (1, 2, 3)}
    freqs = spark.createDataFrame(list(FREQS.items()), "word string, globfreq long")
    rows = spark.createDataFrame([(str(c), i, t, i) for c, texts in corpora.items() for i, t in enumerate(texts)], "corpus string, row_idx int, text string, page int").repartition(7)
    got, changes = vocab.join_in_order(rows, freqs, prefixes=["be", "ver"], rules=rules)
    assert got.columns == rows.columns
    changed = {}
    for r in changes.collect():
        changed.setdefault(r.corpus, {})[r.word] = r.n
    for c, texts in corpora.items():
        want, delta = by_hand(texts, FREQS, rules, ["be", "ver"], True)
        assert [r.text for r in got.where(f"corpus = '{c}'").orderBy("row_idx").collect()] == want
        assert changed[str(c)] == delta
    assert vocab.join_in_order(rows.limit(0), freqs)[0].count() == 0


def test_cleaning_in_order(spark):
    rows = spark.createDataFrame([("a", 0, "", "", "the con#lb#ing said con#lb#ing"), ("a", 1, "", "", "coning and up on him")], "corpus string, row_idx int, bookpart string, paragraph string, text string")
    for in_order in (False, True):
        got, words = drivers.clean_corpus(rows, drivers.Preparation(prefixes=("up",), in_order=in_order))
        assert [r.text for r in got.orderBy("row_idx").collect()][0] == "the coning said coning"
        assert {r.word: r.freq for r in words.collect()}["coning"] == (3 if in_order else 1)


def test_page_breaks_take_the_occurrence_off(spark):
    """The next row's first word is counted already: king stands once, so that once is not knowledge of it."""
    freqs = spark.createDataFrame([("king", 1), ("dom", 1)], "word string, globfreq long")
    rows = spark.createDataFrame([("a", 0, "", "", "the king#lb#"), ("a", 1, "", "", "dom come")], "corpus string, row_idx int, bookpart string, paragraph string, text string")
    got = [r.text for r in vocab.join_page_breaks(rows, freqs).orderBy("row_idx").collect()]
    assert got == ["the king#lb#", "dom come"]  # kingdom unknown, king known, dom (taken off) unknown but not short
    rows = rows.selectExpr("corpus", "row_idx", "bookpart", "paragraph", "replace(text, 'dom', 'do') as text")
    got = [r.text for r in vocab.join_page_breaks(rows, spark.createDataFrame([("king", 1), ("do", 1)], "word string, globfreq long")).orderBy("row_idx").collect()]
    assert got == ["the kingdo", "come"]
