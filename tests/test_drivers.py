"""Whole chains: preparation, training, grid runs, presets, and the sources they read."""

import random

import pyarrow as pa
import pytest

from textloom.operators import similarity as S
from textloom.operators import vocab, wordgraph
from textloom.plans import drivers
from textloom.sources import tables

ROWS = "corpus string, bookpart string, paragraph string, row_idx int, page int, text string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [("a", "1", "1", 0, 1, "The coning rode to the olde stat. He saw the heilig man of the stat and spoke"), ("a", "1", "1", 1, 2, "with him (so they say) of vrede and of the con#lb#ing. And up gaen he went home"), ("a", "1", "2", 2, 2, "the great king="), ("a", "1", "2", 3, 3, "dom of olde. upgaen is a word here"), ("b", "1", "1", 0, 1, "Another corpus of the olde stat."), ("b", "1", "1", 1, 1, "  ")],
        ROWS,
    )


def test_three_phases(spark, rows):
    cleaned, words = drivers.clean_corpus(rows, drivers.Preparation(prefixes=("up",)))
    got = {(r.corpus, r.row_idx): r.text for r in cleaned.collect()}
    assert ("b", 1) not in got and "coning" in got["a", 1] and "#lb#" not in got["a", 1]
    assert "kingdom" in got["a", 2] and not got["a", 3].startswith("dom")
    count = {r.word: r.globfreq for r in vocab.totals(words).collect()}
    assert count["coning"] == 1 and "con" not in count and "ing" not in count and "king=" not in count


def test_line_ends_until_none_is_left(spark):
    freqs = spark.createDataFrame([(w, 5) for w in ("ab", "cd", "ef", "gh", "efgh")], "word string, globfreq long")
    rows = spark.createDataFrame([("ab#lb#cd#lb#ef#lb#gh#lb#ab#lb#cd #lb# ef#lb#gh",)], "text string")
    got = vocab.join_line_ends(rows, freqs).first().text
    assert "#lb#" not in got and "efgh" in got and got.replace(" ", "") == "abcdefghabcdefgh"


def test_variants_and_representations(spark, rows):
    lemmas = spark.createDataFrame([("olde", "old"), ("stat", "stadt")], "form string, lemma string")
    got = drivers.prepare(rows, drivers.Preparation(rules=(("y", "i"),)), {"lem": lemmas})
    assert {v for v, _ in got} == {"unnorm", "norm", "unnorm-lem", "norm-lem"} and {r for _, r in got} == {"full", "sentences", "ngrams"}
    full = {r.docid: r.text for r in got["unnorm-lem", "full"].collect()}
    assert "old stadt" in full["b"] and "they" in full["a"]
    assert "thei" in {r.docid: r.text for r in got["norm", "full"].collect()}["a"]
    assert got["unnorm", "ngrams"].count() > 0 and got["unnorm", "sentences"].count() > 0


def test_models_and_resume(spark, tmp_path):
    words = ["coning", "koning", "koninck", "coninc", "vrede", "vreden", "stat", "stadt", "heilig", "hillig", "und", "vnd", "xxxx"]
    nodes = spark.createDataFrame(list(enumerate(words)), "id long, form string")
    external = spark.createDataFrame([("vrede", "friede"), ("xxxx", "stadt"), ("stat", "stadt")], "form string, lemma string")
    folder = str(tmp_path / "communities")
    models = drivers.train_models(nodes, S.word_edges(nodes), S.matrix(S.PHONETIC, {-0.5: S.VOWELS}), external, folder)
    lem = {r.form: r.lemma for r in models["lem"].collect()}
    assert set(lem) == set(words) and lem["und"] == lem["vnd"] and lem["vrede"] == lem["vreden"]
    assert set(models) == {"lem", "lem-ft", "lem-ren"} and models["lem-ren"].count() == len(words)
    assert wordgraph.resume(spark, folder).count() == len(words) and wordgraph.resume(spark, str(tmp_path / "none")) is None
    wordgraph.save_round(nodes.selectExpr("id as com_id", "id"), folder, 10)
    wordgraph.save_round(nodes.limit(1).selectExpr("id as com_id", "id"), folder, 2)
    assert wordgraph.resume(spark, folder).count() == len(words)  # round 10 comes after round 2
    again = drivers.train_models(nodes, S.word_edges(nodes), S.matrix(S.PHONETIC, {-0.5: S.VOWELS}), folder=folder)
    assert {r.form: r.lemma for r in again["lem"].collect()} == {w: "123" if w == "xxxx" else w for w in words}  # xxxx is a number


@pytest.mark.parametrize("algo", ["louvain", "greedy", "girvan_newman", "lpa"])
def test_community_algorithms(spark, algo):
    """Two cliques of five with one weak link between them."""
    links = [(a, b, 1.0) for g in (0, 5) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(4, 5, 0.1 if algo != "girvan_newman" else 9.0)]
    nodes = spark.createDataFrame([(i, str(i)) for i in range(11)], "id long, form string")
    got = {r.id: r.com_id for r in wordgraph.communities(nodes, spark.createDataFrame(links, "src long, dst long, weight double"), algo=algo).collect()}
    assert got == {**{i: 0 for i in range(5)}, **{i: 5 for i in range(5, 10)}, 10: 10}


def texts(spark):
    rnd = random.Random(3)
    words = [a + b for a in "ka lo mi nu te ra so vi".split() for b in "ban ner rit tol zul lag".split()]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = prose(25)
    x, y = prose(30) + " " + shared + " " + prose(30), prose(20) + " " + shared + " " + prose(10)
    docs = spark.createDataFrame([("a", "a1", x), ("b", "b1", y), ("b", "b2", prose(60))], "series string, docid string, text string")
    start = lambda t: len(t[: t.index(shared)].split())
    return docs, [("a1", start(x), start(x) + 24), ("b1", start(y), start(y) + 24)], [("a1", x.index(shared), x.index(shared) + len(shared) - 1), ("b1", y.index(shared), y.index(shared) + len(shared) - 1)]


def test_grid_of_real_runs(spark):
    docs, in_words, in_chars = texts(spark)
    gold = spark.createDataFrame([("g1", *p) for p in in_chars], "match_id string, docid string, start long, end long")
    grid = [("window", {"ngram": 3, "window": 10, "in_docs": n, "in_window": 3, "minimum": 3, "max_gap": 5}) for n in (3, 500)]
    done = drivers.evaluate_runs({"unnorm/full": docs, "norm-lem-ft/full": docs}, gold, grid)
    got = {(r.input, r.config["in_docs"]): r for r in drivers.score_runs(gold, done).collect()}
    hit, miss = got["unnorm/full", "3"], got["norm-lem-ft/full", "500"]
    assert hit.r_m == hit.p_m == hit.f_m == 1 and hit.r_ch > 0.85 and hit.f_cl == 1 and hit.goldmatch_no == 1 and (hit.norm, hit.lem, hit.seg) == (0, 0, "full")
    assert miss.f_m == 0 and miss.testmatch_no == 0 and (miss.norm, miss.lem) == (1, 2)
    scores, passages = drivers.run_best({"unnorm/full": docs}, gold, {"unnorm/full": docs}, "window", [p for _, p in grid])
    assert scores.count() == 2 and {r.docid for r in passages.collect()} == {"a1", "b1"}


def test_presets(spark):
    docs, _, in_chars = texts(spark)
    got = drivers.final_run({"seed": docs, "gram": docs, "window": docs}).collect()
    for tool in ("seed", "gram", "window"):
        for docid, start, end in in_chars:
            assert any(r.tool == tool and r.docid == docid and r.start <= start + 20 and r.end >= end - 20 for r in got)


def test_gold_from_markers(spark):
    rows = spark.createDataFrame([("x", 0, "ab$segstart_1_free_2$cd$segend_1$ef"), ("y", 0, "$segstart_2_free_1$gh$segend_2$")], "docid string, row_idx int, text string")
    docs, gold = drivers.prepare_gold(rows)
    assert {r.text for r in docs.collect()} == {"abcdef", "gh"} and {(r.docid, r.start, r.end) for r in gold.collect()} == {("x", 2, 3), ("y", 0, 1)}


def test_lz4_lines(spark, tmp_path):
    lines = "".join(f'{{"source_filename":"f{i}","n":{i}}}\n' for i in range(50_000))
    with pa.CompressedOutputStream(str(tmp_path / "a.lz4"), "lz4") as f:
        f.write(lines.encode())
    got = tables.read_lz4_lines(spark, str(tmp_path), "source_filename string, n long")
    assert got.count() == 50_000 and got.agg({"n": "sum"}).first()[0] == sum(range(50_000))
