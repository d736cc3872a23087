"""Operators of textloom.llm against brute force, exact round trips and held-out accuracy, on small odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import bpe, imatch, language, mixing, near_dedup, permutation_index, quality, sanitise, statistics, substring_dedup, toxicity
from textloom.llm import kernels as K
from textloom.llm.components import components

RND = random.Random(4)
WORDS = [a + b for a in "ka lo mi nu te ra so vi".split() for b in "ba ne ri to zu la".split()]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


BASE = prose(120)
LONG = prose(60)
ODD = [
    (1, BASE), (2, BASE), (3, BASE.replace(" ka", " KA")), (4, " ".join(BASE.split()[:112]) + " other end of it"), (5, None), (6, ""), (7, " \n\t"), (8, "word"), (9, "Word"),
    (10, prose(40) + "\n" + LONG + " x"), (11, LONG + " mail a.b+c@x-y.example.com ip 10.0.0.255 1.2.3.400 card 4111 1111 1111 1111 tel +1 (555) 010-9999."), (12, "é\x1c\x85　日本語 😀 <|endoftext|> don't"), (13, "lo " * 200), (14, prose(20_000)),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, and columns that clash with internal names."""
    rows = [(i, t, None if i % 3 == 0 else "abc"[i % 3], None, "k", i) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, ids string, size int")


def test_words_equal_split():
    col = pa.array([t for _, t in ODD])
    data, offs = K.flat(col)
    h, s, e, at = K.words(data, offs)
    for i, (_, t) in enumerate(ODD):
        want = (t or "").encode().split()
        assert [data[a:b].tobytes() for a, b in zip(s[at[i] : at[i + 1]], e[at[i] : at[i + 1]])] == want
    table = {}
    for k, a, b in zip(h.tolist(), s, e):
        assert table.setdefault(k, data[a:b].tobytes()) == data[a:b].tobytes()


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(50, 60), (60, 55), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and got[55] == got[60] == 50
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_near_duplicates(spark, odd):
    rnd = random.Random(9)
    more = []
    for i in range(100, 160):  # a chain of copies, each a few words from the last
        w = (more[-1][1] if more else prose(80, rnd)).split()
        for _ in range(rnd.choice([1, 3, 8])):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        more.append((i, " ".join(w)))
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    sets = {i: shingles(t, 2) for i, t in ODD + more}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, k=2).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_bayes_prunes_by_bound():
    (t, need), *_ = near_dedup.cut_table(0.8, 1e-6)
    assert 0 < need < 0.8 * t and near_dedup.cut_table(0.8, 1e-3)[0][1] > need


def test_repeats(spark, odd):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(odd).collect()}
    rows = [(i, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t in ODD]
    seen = {}
    for i, w in rows:
        for j in range(len(w) - 34):
            seen[tuple(w[j : j + 35])] = seen.get(tuple(w[j : j + 35]), 0) + 1
    for i, w in rows:
        keep = [True] * len(w)
        for j in range(len(w) - 34):
            if seen[tuple(w[j : j + 35])] > 1:
                keep[j : j + 35] = [False] * 35
        left = [x for x, k in zip(w, keep) if k]
        assert got[i] == (len(w), len(w) - len(left), " ".join(left)), i
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_base_spans():
    t = ODD[10][1]
    assert [(k, t[a:b]) for k, a, b in sanitise.base_spans(t)] == [("email", "a.b+c@x-y.example.com"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999")]
    assert sanitise.base_spans("@@ a@b @c.d 1234567812345678") == []


def test_disclosing_terms(spark):
    rnd = random.Random(2)
    docs = [(i, prose(60, rnd) + (f" falconer writes to secret.one@x.example.com {prose(5, rnd)}" if i % 120 == 0 else "")) for i in range(600)]
    rows = {r.doc_id: r for r in sanitise.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert "falconer" not in rows[120].sanitised and "[EMAIL]" in rows[120].sanitised and "secret.one" not in rows[120].sanitised
    assert all(rows[i].sanitised == t for i, t in docs if i % 120)
    assert sanitise.sanitise(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_hide_no_term(spark):
    """One document of an entity stands there a hundred times: its terms disclose as much as without the copies."""
    rnd = random.Random(2)
    docs = [(i, prose(60, rnd) + (f" falconer writes to secret.one@x.example.com {prose(5, rnd)}" if i % 120 == 0 else "")) for i in range(600)]
    docs += [(1000 + i, docs[120][1]) for i in range(100)]
    rows = {r.doc_id: r for r in sanitise.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert not any("falconer" in rows[i].sanitised for i in (0, 120, 240, 1000, 1099))
    assert all(rows[i].sanitised == t for i, t in docs if i < 1000 and i % 120)


def test_bpe(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    for r in bpe.decode(bpe.encode(odd, path), path).collect():
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == lib.decode(want, skip_special_tokens=False)


def test_mixing(spark, odd):
    rows = mixing.mix(odd).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(odd).collect()}
    took, target = {}, {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and again[r.doc_id] == r.taken
        took[r.sources[0]] = took.get(r.sources[0], 0) + r.taken
        target[r.sources[0]] = r.target
    assert all(abs(took[s] - target[s]) <= 1 for s in took)
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450, 2) == [200.0, pytest.approx(166.6667, abs=1e-3), pytest.approx(83.3333, abs=1e-3)]
    # an overlapping document serves the source that needs it
    assert mixing.flow([((0,), 10), ((0, 1), 10)], [10, 10], 2) == [10, 10]
    assert sum(mixing.flow([((0,), 10), ((0, 1), 10)], [15, 15], 2)) == 30
    assert mixing.mix(odd.limit(0)).count() == 0


def test_language(spark):
    rnd = random.Random(3)
    make = {"en": "the of and thing with that", "de": "der und nicht schon über ein", "fr": "le la être pour avec une", "es": "el los que ción para una"}
    rows = [(i, " ".join(rnd.choice(make[la].split()) + rnd.choice(["", "en", "er"]) for _ in range(40)), la) for i, la in enumerate(list(make) * 60)]
    rows += [(900, None, "en"), (901, "123 !!", None), (902, "", "xx")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und"
    held = [(i, la) for i, _, la in rows[:240] if got[i].held_out]
    assert held and np.mean([got[i].lang_pred == la for i, la in held]) > 0.95
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)


def test_every_language_is_learned(spark):
    """More languages than one family may hold, all of them found again."""
    rnd = random.Random(12)
    sound = {f"l{j}": ["".join(rnd.choice("bcdfghjklmnpqrstvwxz") + rnd.choice("aeiou") for _ in range(3)) for _ in range(5)] for j in range(210)}
    rows = [(i, " ".join(rnd.choice(sound[la]) for _ in range(30)), la) for i, la in enumerate(list(sound) * 8)]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(set(got.values())) == 210 and np.mean([got[i] == la for i, _, la in rows]) > 0.95


def test_imatch(spark, odd):
    rows = sorted(((r.doc_id, r) for r in imatch.fingerprint_documents(odd).collect()), key=lambda x: x[0])
    texts = [t or "" for _, t in ODD]
    for k, (i, r) in enumerate(rows):
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        h = len(t) // 2
        assert r.n_chars == len(t) and r.edited == t[: len(t) - h] + nxt[:h] and 0 <= r.near_edited <= 1
    assert rows[0][1].fingerprint == rows[1][1].fingerprint and rows[0][1].near_next == 1
    assert imatch.fingerprint_documents(odd.limit(0)).count() == 0


def test_toxicity_and_quality(spark):
    rnd = random.Random(5)
    bad = ["scumbag", "moronic", "vileness"]
    docs, labels = [], []
    for i in range(400):
        tox, low = i % 4 == 0, i % 5 == 0
        text = prose(40, rnd) if not low else (rnd.choice(WORDS) + " ") * 40
        docs.append((i, text + (" " + rnd.choice(bad) + " ka" if tox else "")))
        labels.append((i, int(not low), int(tox)))
    d = spark.createDataFrame([*docs, (999, None), (998, "")], "doc_id long, text string")
    la = spark.createDataFrame([*labels, (5000, None, None)], "doc_id long, quality int, toxic int")
    for got, at in ((toxicity.score(d, la), 2), (quality.score(d, la), 1)):
        got = {r.doc_id: r for r in got.collect()}
        assert len(got) == 402 and all(0 <= r.score <= 1 for r in got.values())
        held = [x for x in labels if got[x[0]].held_out]
        assert held and np.mean([got[x[0]].predicted == x[at] for x in held]) > 0.9
    for f in (toxicity.score, quality.score):
        assert f(d, la.limit(0)).count() == 402 and f(d.limit(0), la).count() == 0


def test_statistics_of_empty():
    assert not statistics.measure(pa.array([None, "", " "])).any()


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (350, [0.0] * 16), (400, [float("nan")] * 16)]
    got = permutation_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 300, 50):
        s = u @ u[q]
        s[q] = -9
        want = np.lexsort((np.arange(300), -s))[:5].tolist()
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert {r.query_id for r in got} == {0, 50, 100, 150, 200, 250}


def test_sha_of_nothing(spark, odd):
    r = {x.doc_id: x for x in sanitise.digests(odd).collect()}
    assert r[5].base_sha256 == hashlib.sha256(b"").hexdigest() and r[5].spans == ""


def test_pipeline_columns(spark, odd, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    labels = spark.createDataFrame([(1, 1, 0), (13, 0, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "tokens"]
    assert {"doc_id", "ids"} <= set(pipeline.run(spark, str(tmp_path)).columns)


def test_pipeline_rows_without_or_with_equal_ids(spark, tmp_path):
    """Rows of null or repeated ids pass every stage as documents of their own."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(6)
    mail = "write to a.b@example.com now " + prose(30, rnd)
    texts = [(None, mail), (None, prose(40, rnd)), (7, prose(40, rnd)), (7, prose(40, rnd) + " c.d@example.com"), (8, mail), (8, mail)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    run = lambda stage, d=docs: sorted(((r.doc_id or 0, r.text) for r in stage(spark, d, str(tmp_path)).collect()))
    rows = sorted((i or 0, t) for i, t in texts)
    assert run(pipeline.keep_quality) == rows  # no labels: every score is 0.5
    assert run(pipeline.keep_one_of_near_duplicates) == sorted([(0, texts[1][1]), (7, texts[2][1]), (7, texts[3][1]), (8, mail)])
    clean = lambda t: t.replace("a.b@example.com", "[EMAIL]").replace("c.d@example.com", "[EMAIL]")
    assert run(pipeline.hide_personal_data) == sorted((i, clean(t)) for i, t in rows)
    mixed = run(pipeline.mix_sources)
    assert set(mixed) <= set(rows) and {0, 7, 8} <= {i for i, _ in mixed}
    assert pipeline.encode_tokens(spark, docs, str(tmp_path)).count() == 6
