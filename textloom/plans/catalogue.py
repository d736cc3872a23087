"""The engine's registered queries and their DuckDB equivalents.

Each query applies operators to whole tables. Keys begin with what they do;
the operator ids they cover stand in the comments. SQL is given where both
engines express the same semantics exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import clean, detect, extract, matches, reports, segment, similarity, structure, vocab, wordgraph
from textloom.plans import drivers
from textloom.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_TOK = "unnest(regexp_extract_all(lower(text), '[a-z]+'))"
_VOC = f"v AS (SELECT word, docid, count(*) AS freq FROM (SELECT lang AS docid, {_TOK} AS word FROM documents) GROUP BY ALL)"
_FRQ = f"f AS MATERIALIZED (SELECT word, count(*) AS globfreq FROM (SELECT {_TOK} AS word FROM documents) GROUP BY ALL)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _vocab(s: SparkSession, d: str) -> DataFrame:
    return vocab.vocabulary(table(s, d, "documents"), "lang")


def _series(s: SparkSession, d: str) -> DataFrame:
    """documents and benchmark as two series of one collection."""
    a = table(s, d, "documents").select(F.lit("d").alias("series"), F.concat(F.lit("d"), F.col("doc_id")).alias("docid"), F.lower("text").alias("text"))
    b = table(s, d, "benchmark").select(F.lit("b").alias("series"), F.concat(F.lit("b"), F.col("item_id")).alias("docid"), F.lower("text").alias("text"))
    return a.union(b)


#: White space of all scripts, for DuckDB.
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# --- vocabulary (V1-V7)


@query(f"WITH {_VOC} SELECT word, CAST(sum(freq) AS BIGINT) AS globfreq FROM v GROUP BY word")
def vocab_global(s, d):
    return vocab.totals(_vocab(s, d))


@query(f"WITH {_VOC} SELECT word, docid, freq FROM v")
def vocab_by_doc(s, d):
    return _vocab(s, d).select("word", "docid", "freq")


@query(f"WITH {_VOC} SELECT word, CAST(sum(freq) AS BIGINT) AS globfreq, count(*) AS ndocs FROM v GROUP BY word")
def vocab_export(s, d):
    return vocab.export(_vocab(s, d))


@query(f"WITH {_VOC} SELECT docid, CAST(sum(freq) AS BIGINT) AS wcount FROM v GROUP BY docid")
def vocab_doc_totals(s, d):
    return vocab.doc_totals(_vocab(s, d))


@query(f"WITH {_VOC}, g AS (SELECT word, 'en' AS docid, count(*) AS n FROM (SELECT {_TOK} AS word FROM benchmark) GROUP BY ALL) SELECT v.word, v.docid, CAST(freq - coalesce(n, 0) AS BIGINT) AS freq FROM v LEFT JOIN g USING (word, docid) WHERE freq - coalesce(n, 0) > 0")
def vocab_remove(s, d):
    gone = vocab.vocabulary(table(s, d, "benchmark").withColumn("l", F.lit("en")), "l")
    return vocab.remove(_vocab(s, d), gone)


@query(f"WITH {_VOC}, w AS (SELECT DISTINCT {_TOK} AS word FROM benchmark), t AS (SELECT word, sum(freq) AS n FROM v GROUP BY word) SELECT word, CAST(coalesce(n, 0) AS BIGINT) AS globfreq, CAST(coalesce(e.freq, -1) AS BIGINT) AS docfreq FROM w LEFT JOIN t USING (word) LEFT JOIN (SELECT * FROM v WHERE docid = 'en') e USING (word)")
def vocab_lookup(s, d):
    words = vocab.tokens(table(s, d, "benchmark"), "item_id").select("word").distinct()
    return vocab.lookup(words, _vocab(s, d), "en")


# --- cleaning

_RULES = [("oe", "o"), ("ai", "a"), ("ei+", "e"), ("y", "i"), ("j", "i"), ("dt", "t"), ("ck", "k"), ("gh", "g"), ("ß", "s")]
_FOLDED = "lower(text)"
for _a, _b in _RULES:
    _FOLDED = f"regexp_replace({_FOLDED}, '{_a}', '{_b}', 'g')"


@query(f"SELECT doc_id, md5({_FOLDED}) AS text_md5 FROM documents")
def clean_rules(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(clean.normalise(F.col("text"), (), _RULES).cast("binary")).alias("text_md5"))


@query("SELECT doc_id, md5(replace(replace(regexp_replace(regexp_replace(text, '#|⸿', '#CSTART#', 'g'), '[.:!?]', '#SEND#', 'g'), '(', '#INSTART#'), ')', '#INEND#')) AS text_md5 FROM documents")
def clean_markers(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(clean.mark_boundaries(F.col("text")).cast("binary")).alias("text_md5"))


@query("SELECT doc_id, md5(regexp_replace(text, '([a-zßöů])([A-Z])', '\\1 \\2', 'g')) AS text_md5 FROM documents")
def clean_camel(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(clean.split_camel(F.col("text")).cast("binary")).alias("text_md5"))


_W = r"[\pL\pM\p{Nd}\p{Pc}]"
_GLUE = "regexp_replace({0}, '(" + _W + r")[\x09-\x0d\x{85} \x{a0}\x{2028}\x{2029}\x{2000}-\x{200a}\x{3000}]([befghknopqrstwyz])([^\pL\pM\p{Nd}\p{Pc}])', '\1' || chr(57344) || '\2\3', 'g')"


@query("SELECT doc_id, md5(replace(" + _GLUE.replace("{0}", _GLUE.replace("{0}", "text")) + ", chr(57344), '')) AS text_md5 FROM documents")
def clean_glue(s, d):
    """C2."""
    return table(s, d, "documents").select("doc_id", F.md5(clean.glue_consonant(F.col("text")).cast("binary")).alias("text_md5"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[\x09-\x0d\x{85} \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS text_md5 FROM documents")
def clean_squeeze(s, d):
    """C7."""
    return table(s, d, "documents").select("doc_id", F.md5(clean.squeeze(F.col("text")).cast("binary")).alias("text_md5"))


@query(f"WITH {_FRQ} SELECT word, globfreq FROM f WHERE regexp_matches(word, '^[ijvxlcdmIJVXLCDM]+$') AND NOT regexp_matches(word, '^[vV][ijIJ]{{1,2}}[lL][lL]?$') AND NOT regexp_matches(word, '^[ijIJ]{{1,2}}[mM]')")
def roman_numbers(s, d):
    return vocab.totals(_vocab(s, d)).where(clean.is_number(F.col("word")))


@query()
def clean_full(s, d):
    """Lookaround rules as well, so no SQL; tests hold it against Python's re."""
    rules = [(r"(?<!\w)[uv]p(?!\w)", "up"), (r"(?<!\w)ch", "k"), (r"v(?=[^aeiourl])", "u")]
    return clean.clean_rows(table(s, d, "documents").select("doc_id", "text"), rules=rules)


_BARE = "regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '#|⸿', '#CSTART#', 'g'), '[.:!?]', '#SEND#', 'g'), '[)]', '#INEND#', 'g'), '(', ''), '#SEND#|#CSTART#|#INEND#|#lb#|=', ' ', 'g')"
_WHITE = r"\t\n\x0b\f\r "


@query(rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all({_BARE}, '[^{_WHITE}]+|[{_WHITE}]+')) AS w, generate_subscripts(regexp_extract_all({_BARE}, '[^{_WHITE}]+|[{_WHITE}]+'), 1) AS i FROM documents),
h AS (SELECT *, length(regexp_extract(w, '^(?s:.*)\$')) AS n FROM w), j AS (SELECT doc_id, string_agg(left(w, n) || replace(w[n + 1:], '-', ' '), '' ORDER BY i) AS t FROM h GROUP BY doc_id)
SELECT doc_id, trim(replace(regexp_replace(coalesce(t, text), '[\x09-\x0d\x{{85}} \x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'), '$ segend_', '$segend_'), ' ') AS text FROM documents LEFT JOIN j USING (doc_id)""")
def clean_second(s, d):
    """C12."""
    return table(s, d, "documents").select("doc_id", clean.plain(clean.mark_boundaries(F.col("text"))).alias("text"))


# --- word joining

_BIGRAMS = "b AS MATERIALIZED (SELECT DISTINCT w[i] AS t1, w[i + 1] AS t2 FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)))"
_NUM = "(regexp_matches({0}, '^[ijvxlcdm]+$') AND NOT regexp_matches({0}, '^v[ij]{{1,2}}ll?$') AND NOT regexp_matches({0}, '^[ij]{{1,2}}m'))"
_N1, _N2 = _NUM.format("t1"), _NUM.format("t2")
_RULE = f"""CASE WHEN fj = 0 AND fa = 0 AND fb = 0 THEN false WHEN fj > 0 AND fa = 0 AND fb = 0 THEN true WHEN fj = 0 AND fa > 0 AND fb > 0 THEN false
WHEN fj > 0 AND (fa > 0) <> (fb > 0) THEN NOT CASE WHEN fa > 0 THEN {_N1} ELSE {_N2} END
WHEN fj = 0 AND (fa > 0) <> (fb > 0) THEN NOT ({_N1} OR {_N2}) AND length(CASE WHEN fa > 0 THEN t2 ELSE t1 END) < 3
ELSE NOT ({_N1} OR {_N2}) AND (fj >= 2 OR fa = 1 OR fb = 1) END"""
_DECIDE = f"""WITH {_FRQ}, {_BIGRAMS}, x AS (SELECT t1, t2, coalesce(j.globfreq, 0) AS fj, coalesce(a.globfreq, 0) AS fa, coalesce(c.globfreq, 0) AS fb FROM b
LEFT JOIN f j ON j.word = t1 || t2 LEFT JOIN f a ON a.word = t1 LEFT JOIN f c ON c.word = t2)
SELECT t1, t2, {_RULE} AS is_join FROM x"""


def _bigrams(s, d):
    words = table(s, d, "documents").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.struct(F.get("w", i).alias("t1"), F.get("w", i + 1).alias("t2")))
    return words.select(F.explode(F.when(F.size("w") >= 2, pairs)).alias("p")).select("p.t1", "p.t2").distinct()


def _freqs(s, d):
    """Frequencies of all words, written: joins ask for them more than once."""
    return tables.written(vocab.frequencies(table(s, d, "documents")), "frequencies")


@query(_DECIDE)
def join_decision(s, d):
    return vocab.decide(_bigrams(s, d), _freqs(s, d)).select("t1", "t2", "is_join")


@query(f"WITH {_FRQ}, {_BIGRAMS} SELECT t1, t2, coalesce(j.globfreq, 0) > 0 AND length(t2) > 3 AND coalesce(c.globfreq, 0) < coalesce(j.globfreq, 0) AS is_join FROM b LEFT JOIN f j ON j.word = t1 || t2 LEFT JOIN f c ON c.word = t2")
def prefix_join(s, d):
    return vocab.decide(_bigrams(s, d), _freqs(s, d), prefix=True).select("t1", "t2", "is_join")


@query()
def line_end_join(s, d):
    rows = table(s, d, "documents").select("doc_id", F.lower(F.replace("text", F.lit("\n"), F.lit("#lb#"))).alias("text"))
    return vocab.join_line_ends(rows, vocab.totals(_vocab(s, d)))


_GAP = r"[\x09-\x0d\x{85} \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"


@query(f"""WITH {_FRQ}, r AS (SELECT doc_id AS corpus, k AS row_idx, substr(t, CAST(k * 200 + 1 AS BIGINT), 200) || '#lb#' AS text FROM (SELECT doc_id, lower(text) AS t, unnest(range(0, greatest(1, (length(text) + 199) // 200))) AS k FROM documents)),
x AS (SELECT *, lead(text) OVER (PARTITION BY corpus ORDER BY row_idx) AS nxt, regexp_extract(text, '({_W}+){_GAP}#lb#$', 1) AS t1 FROM r), y AS (SELECT *, regexp_extract(coalesce(nxt, ''), '^{_GAP}({_W}+)', 1) AS t2 FROM x),
z AS (SELECT y.*, coalesce(j.globfreq, 0) AS fj, coalesce(a.globfreq, 0) AS fa, greatest(coalesce(c.globfreq, 0) - 1, 0) AS fb FROM y LEFT JOIN f j ON j.word = t1 || t2 LEFT JOIN f a ON a.word = t1 LEFT JOIN f c ON c.word = t2),
d AS (SELECT *, coalesce(t1 <> '' AND t2 <> '' AND NOT starts_with(nxt, '#') AND {_RULE}, false) AS takes FROM z),
g AS (SELECT corpus, row_idx, CASE WHEN takes THEN regexp_replace(text, '{_W}*{_GAP}#lb#$', '') || t1 || t2 ELSE text END AS text, coalesce(lag(takes) OVER (PARTITION BY corpus ORDER BY row_idx), false) AS given FROM d)
SELECT corpus, CAST(row_idx AS INTEGER) AS row_idx, CASE WHEN given THEN regexp_replace(text, '^{_GAP}{_W}+{_GAP}', '') ELSE text END AS text FROM g""")
def page_break_join(s, d):
    """Documents cut into pages of 200 characters, words and all."""
    pages = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length("text") / 200).cast("int")) - 1), lambda k: F.substr(F.lower("text"), k * 200 + 1, F.lit(200)))
    rows = table(s, d, "documents").select(F.col("doc_id").alias("corpus"), F.lit("").alias("bookpart"), F.lit("").alias("paragraph"), F.posexplode(pages).alias("row_idx", "t"))
    rows = rows.select("corpus", "bookpart", "paragraph", "row_idx", F.concat("t", F.lit("#lb#")).alias("text"))
    return vocab.join_page_breaks(rows, vocab.totals(_vocab(s, d))).select("corpus", "row_idx", "text")


# --- segmentation

_GRAMS5 = "g AS (SELECT {key}, CAST(i - 1 AS INTEGER) AS pos, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT {key}, regexp_extract_all(lower(text), '[a-z]+') AS w FROM {t})))"


@query(f"WITH {_GRAMS5.format(key='doc_id', t='documents')} SELECT doc_id, pos, md5(gram) AS gram_md5 FROM g")
def word_ngrams(s, d):
    return segment.ngrams(table(s, d, "documents"), 5, ["doc_id"]).select("doc_id", "pos", F.md5(F.col("gram").cast("binary")).alias("gram_md5"))


@query(f"WITH {_GRAMS5.format(key='doc_id', t='documents')} SELECT gram, count(DISTINCT doc_id) AS df FROM g GROUP BY gram HAVING count(DISTINCT doc_id) > 1")
def ngram_df(s, d):
    # dealt out by gram first: both steps of the distinct count stay where the gram is, so it is shuffled once
    grams = segment.ngrams(table(s, d, "documents"), 5, ["doc_id"]).repartition("gram")
    return grams.groupBy("gram").agg(F.count_distinct("doc_id").alias("df")).where("df > 1")


def _turns(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("corpus"), F.lit("").alias("bookpart"), F.lit("").alias("paragraph"), F.col("turn").alias("row_idx"), "text", F.col("turn").cast("int").alias("page"))


@query("""WITH t AS (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+') AS w FROM conversations)),
x AS (SELECT conv_id AS corpus, turn AS row_idx, i, w[i] AS a, lead(w[i], 1) OVER o AS b, lead(w[i], 2) OVER o AS c FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, i))
SELECT corpus, row_idx, CAST(i - 1 AS INTEGER) AS pos, a || ' ' || b || ' ' || c AS gram FROM x WHERE c IS NOT NULL""")
def ngrams_across_rows(s, d):
    return segment.ngrams_across(_turns(s, d), 3).select("corpus", "row_idx", "pos", "gram")


@query("""WITH p AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '[.:!?]', '#SEND#', 'g'), '#SEND#|#CSTART#')) AS s FROM documents)
SELECT doc_id, count(*) AS n, CAST(sum(length(trim(s, ' '))) AS BIGINT) AS chars FROM p WHERE trim(s, ' ') <> '' GROUP BY doc_id""")
def sentence_split(s, d):
    pieces = segment.sentence_pieces(F.regexp_replace("text", "[.:!?]", clean.SENTENCE))
    return table(s, d, "documents").select("doc_id", F.explode(pieces).alias("p")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("p")).alias("chars"))


@query()
def sentences_folded(s, d):
    return segment.sentences(_turns(s, d).withColumn("corpus", F.col("corpus").cast("string")).withColumn("text", clean.mark_boundaries(F.col("text"))))


@query("SELECT conv_id AS corpus, turn AS page, CAST(e - length(text) AS BIGINT) AS \"start\", CAST(e AS BIGINT) AS \"end\" FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS e FROM conversations)")
def fulltext_index(s, d):
    return segment.offset_index(_turns(s, d).drop("page").withColumn("page", F.col("row_idx")), "page").select("corpus", "page", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("SELECT conv_id AS corpus, md5(string_agg(text, ' ' ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id")
def full_text(s, d):
    return segment.full_text(_turns(s, d)).select("corpus", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query()
def nested_sentences(s, d):
    """G1 + G2: parentheses segmented again; tests hold it against the pieces one by one."""
    return segment.nested_sentences(_turns(s, d).withColumn("corpus", F.col("corpus").cast("string")).withColumn("text", clean.mark_boundaries(F.col("text"))))


@query()
def insertions(s, d):
    return segment.expand_insertions(table(s, d, "documents").select("doc_id", clean.mark_boundaries(F.col("text")).alias("text")))


# --- detection

_SERIES = "d AS (SELECT 'd' AS series, 'd' || doc_id AS docid, lower(text) AS text FROM documents UNION ALL SELECT 'b', 'b' || item_id, lower(text) FROM benchmark)"
_WG = "g AS (SELECT DISTINCT series, docid, CAST(i - 1 AS INTEGER) AS pos, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT series, docid, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT series, docid, list_filter(regexp_extract_all(text, '[a-z]+'), lambda x: length(x) >= 2) AS w FROM d)))"
_WM = f"WITH {_SERIES}, {_WG}, m AS (SELECT x.docid AS a, y.docid AS b, x.pos AS pa, y.pos AS pb, x.gram FROM (SELECT * FROM g WHERE series = 'b') x JOIN (SELECT * FROM g WHERE series = 'd') y ON x.gram = y.gram)"


def _word_matches(s, d):
    docs = _series(s, d)
    return detect.gram_matches(detect.word_grams(docs, 5), large=detect.large_series(docs))


@query(_WM + " SELECT a, b, count(DISTINCT gram) AS shared FROM m GROUP BY a, b HAVING count(DISTINCT gram) >= 5")
def shared_gram_pairs(s, d):
    return detect.candidate_pairs(_word_matches(s, d), 5)


@query(_WM + """, x AS (SELECT DISTINCT a, b, pa, pa - pb AS diag FROM m), y AS (SELECT *, CASE WHEN pa - lag(pa) OVER o <= 5 THEN 0 ELSE 1 END AS new FROM x WINDOW o AS (PARTITION BY a, b, diag ORDER BY pa)),
z AS (SELECT *, sum(new) OVER (PARTITION BY a, b, diag ORDER BY pa ROWS UNBOUNDED PRECEDING) AS isl FROM y) SELECT a, b, diag, min(pa) AS "start", max(pa) + 4 AS "end", count(*) AS hits FROM z GROUP BY a, b, diag, isl""")
def seed_diagonals(s, d):
    return detect.diagonal_seeds(_word_matches(s, d), 5)


@query(_WM + """, y AS (SELECT *, CASE WHEN coalesce(pa - lag(pa) OVER o > 15 OR abs(pb - lag(pb) OVER o) > 15, true) THEN 1 ELSE 0 END AS new FROM m WINDOW o AS (PARTITION BY a, b ORDER BY pa, pb, gram)),
z AS (SELECT *, sum(new) OVER (PARTITION BY a, b ORDER BY pa, pb, gram ROWS UNBOUNDED PRECEDING) AS isl FROM y)
SELECT a, b, min(pa) AS start_a, max(pa) AS end_a, min(pb) AS start_b, max(pb) AS end_b, count(DISTINCT gram) AS hits FROM z GROUP BY a, b, isl HAVING count(DISTINCT gram) >= 4""")
def gram_islands(s, d):
    return detect.islands(_word_matches(s, d), 15, 4)


@query(_WM + """, y AS (SELECT *, CASE WHEN coalesce(pa - lag(pa) OVER o > 5 OR abs(pb - lag(pb) OVER o) > 5, true) THEN 1 ELSE 0 END AS new,
least(count(*) OVER (PARTITION BY a, b ORDER BY pa RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING), count(*) OVER (PARTITION BY a, b ORDER BY pb RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING)) >= 3 AS dense FROM m WINDOW o AS (PARTITION BY a, b ORDER BY pa, pb, gram)),
z AS (SELECT *, sum(new) OVER (PARTITION BY a, b ORDER BY pa, pb, gram ROWS UNBOUNDED PRECEDING) AS isl FROM y),
u AS (SELECT *, max(dense) OVER (PARTITION BY a, b, isl ORDER BY pa, pb, gram ROWS UNBOUNDED PRECEDING) AS op FROM z)
SELECT a, b, min(pa) AS start_a, max(pa) AS end_a, min(pb) AS start_b, max(pb) AS end_b, count(DISTINCT gram) AS hits FROM u WHERE op GROUP BY a, b, isl HAVING count(DISTINCT gram) >= 3""")
def window_islands(s, d):
    """T5: passages that begin in a dense window."""
    return detect.islands(_word_matches(s, d), 5, 3, window=10, in_window=3)


@query(r"""WITH p AS (SELECT series, docid, unnest(regexp_extract_all(text, '[^\pL\pN]*[\pL\pN]+')) AS piece, generate_subscripts(regexp_extract_all(text, '[^\pL\pN]*[\pL\pN]+'), 1) AS k FROM d),
u AS (SELECT *, length(regexp_extract(piece, '[\pL\pN]+$')) AS n, CAST(sum(length(piece)) OVER (PARTITION BY docid ORDER BY k) AS INTEGER) AS upto FROM p)
SELECT docid, CAST(row_number() OVER (PARTITION BY docid ORDER BY k) - 1 AS INTEGER) AS pos, CAST(upto - n AS INTEGER) AS "start", upto - 1 AS "end", md5(lower(right(piece, n))) AS tok_md5 FROM u WHERE n >= 2""".replace("WITH p", f"WITH {_SERIES}, p"))
def located_tokens(s, d):
    """T5: tokens and the code points that they take."""
    return detect.tokens_of(detect.token_rows(_series(s, d))).select("docid", "pos", "start", "end", F.md5(F.col("tok").cast("binary")).alias("tok_md5"))


@query()
def window_alignment(s, d):
    return detect.window_alignment(_series(s, d), "b", ngram=3, gap=1, window=10, in_docs=3, in_window=3, minimum=3, max_gap=5, word_order=False)


@query()
def gram_alignment(s, d):
    return detect.gram_alignment(_series(s, d), n=25)


@query()
def seed_and_extend(s, d):
    return detect.seed_and_extend(_series(s, d), word_size=7, min_length=15)


# --- similarity and word graph (N1-N7, L1-L20 without L14)


def _forms(s, d):
    """Every word form of the vocabulary, numbered like _nodes."""
    return _numbered(vocab.frequencies(table(s, d, "documents")).select("word"))


def _numbered(words):
    return words.select(F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 14), 16, 10).cast("long").alias("id"), F.col("word").alias("form"))


def _nodes(s, d):
    return _forms(s, d)


def _edges(s, d, n=None):
    """A rule that SQL can express as well: a word and the word without its last letter, weight by length."""
    n = _nodes(s, d) if n is None else n
    longer = n.select(F.col("id").alias("dst"), F.col("form").alias("fb"), F.expr("left(form, length(form) - 1)").alias("fa")).where("fa <> ''")
    return longer.join(n.toDF("src", "fa"), "fa").select("src", "dst", (F.length("fa") / F.length("fb")).alias("weight"))


_NODES = f"{_FRQ}, n AS MATERIALIZED (SELECT word AS form FROM f), e AS MATERIALIZED (SELECT x.form AS fa, y.form AS fb, length(x.form) / length(y.form) AS weight FROM n y JOIN n x ON x.form = y.form[1:len(y.form) - 1]), m AS (SELECT form[1:3] AS com, form FROM n)"


def _members(s, d):
    return _nodes(s, d).select(F.substring("form", 1, 3).alias("com_id"), "id")


@query(f"WITH {_NODES} SELECT form FROM n WHERE form NOT IN (SELECT fa FROM e UNION SELECT fb FROM e)")
def graph_isolates(s, d):
    return wordgraph.isolates(_nodes(s, d), _edges(s, d)).select("form")


@query(f"WITH {_NODES}, i AS (SELECT fa[1:3] AS com, count(*) AS k FROM e WHERE fa[1:3] = fb[1:3] GROUP BY 1) SELECT com AS com_id, count(*) AS n, CASE WHEN count(*) = 1 THEN 1.0 ELSE 2.0::DOUBLE * coalesce(max(k), 0) / (count(*) * (count(*) - 1)) END AS density FROM m LEFT JOIN i USING (com) GROUP BY com")
def graph_density(s, d):
    return wordgraph.density(_members(s, d), _edges(s, d))


@query(f"WITH {_NODES} SELECT com AS com_id, avg(length(form)) AS meanlen FROM m GROUP BY com")
def graph_mean_length(s, d):
    return wordgraph.mean_length(_members(s, d), _nodes(s, d))


@query(f"""WITH {_NODES}, b AS (SELECT fa AS form, weight FROM e WHERE fa[1:3] = fb[1:3] UNION ALL SELECT fb, weight FROM e WHERE fa[1:3] = fb[1:3]), w AS (SELECT form, avg(weight) AS w FROM b GROUP BY form), l AS (SELECT com, avg(length(form)) AS meanlen FROM m GROUP BY com)
SELECT com AS com_id, form AS lemma FROM m JOIN l USING (com) LEFT JOIN w USING (form) QUALIFY row_number() OVER (PARTITION BY com ORDER BY round(coalesce(w, 0), 9) DESC, round(abs(length(form) - meanlen), 9), form) = 1""")
def graph_representative(s, d):
    return wordgraph.representative(_members(s, d), _nodes(s, d), _edges(s, d))


@query("WITH RECURSIVE " + _NODES + """, r AS (SELECT form, form AS root FROM n UNION ALL SELECT r.form, n.form FROM r JOIN n ON n.form = r.root[1:len(r.root) - 1])
SELECT form, arg_min(root, length(root)) AS lemma FROM r GROUP BY form""")
def graph_components(s, d):
    n = _nodes(s, d)
    n = wordgraph._checkpoint(n)
    comp = wordgraph.connected(n.select("id"), wordgraph._checkpoint(_edges(s, d))).join(n, "id")
    return comp.join(comp.groupBy("component").agg(F.min("form").alias("lemma")), "component").select("form", "lemma")


@query(f"WITH {_NODES} SELECT fb AS form, fa AS other, weight FROM e WHERE weight >= 0.5 AND (length(fa) >= 4 OR weight = 1)")
def edge_filter(s, d):
    """L3."""
    n = _nodes(s, d)
    rows = _edges(s, d).join(n.toDF("src", "other"), "src").withColumn("shorter", F.length("other"))
    kept = similarity.refilter(rows, 0.5, 4)
    return kept.join(n.toDF("src", "other"), "src").join(n.toDF("dst", "form"), "dst").select("form", "other", "weight")


_COMS = "c AS (SELECT p_partkey AS com_id, p_size AS n, (p_partkey % 11) / 10.0::DOUBLE AS meansim, (p_partkey % 7) + 0.5::DOUBLE AS meanlen FROM part)"


def _coms(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("com_id"), F.col("p_size").alias("n"), (F.col("p_partkey") % 11 / 10.0).alias("meansim"), (F.col("p_partkey") % 7 + F.lit(0.5)).alias("meanlen"))


@query(f"WITH {_COMS} SELECT com_id FROM c WHERE n > 1 AND ((meansim >= 0.7 AND meanlen > 3) OR (meansim = 1 AND meanlen <= 3))")
def select_wordgroups(s, d):
    """L15."""
    return wordgraph.select_groups(_coms(s, d)).select("com_id")


@query(f"WITH {_COMS} SELECT com_id FROM c WHERE (meansim < 0.8 AND meanlen <= 6) OR meanlen <= 3")
def short_communities(s, d):
    """L14, its selection."""
    return wordgraph.short_word_candidates(_coms(s, d)).select("com_id")


@query()
def word_edges(s, d):
    return similarity.word_edges(_forms(s, d))


@query()
def word_similarity(s, d):
    n = _forms(s, d).select("form")
    return similarity.similarity(n.select(F.col("form").alias("x"), F.reverse("form").alias("y")))


@query()
def word_communities(s, d):
    n = wordgraph._checkpoint(_forms(s, d))
    return wordgraph.communities(n, similarity.word_edges(n), algo="lpa")


@query()
def pseudo_lemmas(s, d):
    n = wordgraph._checkpoint(_forms(s, d))
    return wordgraph.train(n, similarity.word_edges(n), algo="lpa")[1]


_LEM = f"p AS (SELECT w[1:4] AS form, w AS lemma FROM (SELECT {_TOK} AS w FROM documents) WHERE length(w) >= 5), q AS (SELECT form, lemma, count(*) AS n FROM p GROUP BY ALL), l AS (SELECT form, lemma FROM q QUALIFY row_number() OVER (PARTITION BY form ORDER BY n DESC, lemma) = 1)"


_MARKED = "replace(replace(replace(lower(text), 'ä', 'aͤ'), 'ö', 'oͤ'), 'ü', 'uͤ')"


@query(f"""WITH t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all({_MARKED}, '[a-zͤ]+') AS w FROM documents)),
o AS (SELECT doc_id * 1000000 + i - 1 AS ord, w[i] AS form, w[i][1:2] AS lemma FROM t),
v AS (SELECT ord, lemma, unnest(CASE WHEN regexp_full_match(form, '[a-z]+') THEN [form] WHEN contains(form, 'aͤ') THEN [replace(form, 'aͤ', 'a'), replace(form, 'aͤ', 'ae')]
WHEN contains(form, 'eͤ') THEN [replace(form, 'eͤ', 'e'), replace(form, 'eͤ', 'ee')] WHEN contains(form, 'oͤ') THEN [replace(form, 'oͤ', 'o'), replace(form, 'oͤ', 'oe')]
WHEN contains(form, 'uͤ') THEN [replace(form, 'uͤ', 'u'), replace(form, 'uͤ', 'ue')] ELSE CAST([] AS VARCHAR[]) END) AS form FROM o),
n AS (SELECT form, lemma, count(*) AS n, min(ord) AS first FROM v GROUP BY ALL)
SELECT form, lemma FROM n QUALIFY row_number() OVER (PARTITION BY form ORDER BY n DESC, first, lemma) = 1""")
def reference_lemmas(s, d):
    """Umlauts stand for letters with an e above them, the first two letters of a token for its lemma."""
    text = F.lower("text")
    for a, b in zip("äöü", "aou"):
        text = F.replace(text, F.lit(a), F.lit(b + "ͤ"))
    words = table(s, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all(text, F.lit("[a-zͤ]+"), F.lit(0))).alias("k", "form"))
    lemma = F.substring("form", 1, 2)
    return wordgraph.reference_lemmas(words.select((F.col("doc_id") * 1_000_000 + F.col("k")).alias("ord"), "form", lemma.alias("simple"), lemma.alias("lemma")))


@query(f"WITH {_LEM} SELECT form, lemma FROM l")
def lemma_majority(s, d):
    return wordgraph.majority_lemma(_lemma_pairs(s, d))


def _lemma_pairs(s, d):
    return vocab.tokens(table(s, d, "documents"), "doc_id").where("length(word) >= 5").select(F.substring("word", 1, 4).alias("form"), F.col("word").alias("lemma"))


@query(f"WITH {_LEM}, t AS (SELECT item_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS tok FROM (SELECT doc_id AS item_id, string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' ') AS w FROM documents)) SELECT item_id, md5(string_agg(coalesce(lemma, tok), ' ' ORDER BY i)) AS text_md5 FROM t LEFT JOIN l ON form = tok GROUP BY item_id")
def lemmatize_text(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("item_id"), F.regexp_replace(F.lower("text"), "[^a-z ]", "").alias("text"))
    out = wordgraph.lemmatise(rows, wordgraph.majority_lemma(_lemma_pairs(s, d)), ["item_id"])
    return out.select("item_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_GROUPS = "gr AS (SELECT DISTINCT l_orderkey AS group_id, l_partkey AS form FROM lineitem), ex AS (SELECT p_partkey AS form, p_type AS lemma FROM part)"


@query(f"WITH {_GROUPS}, c AS (SELECT DISTINCT group_id, lemma FROM gr JOIN ex USING (form)), c2 AS (SELECT * FROM c WHERE lemma IN (SELECT lemma FROM c GROUP BY lemma HAVING count(*) >= 2)), c3 AS (SELECT * FROM c2 WHERE group_id NOT IN (SELECT group_id FROM c2 GROUP BY group_id HAVING count(*) > 1)) SELECT group_id, lemma FROM c3 WHERE lemma IN (SELECT lemma FROM c3 GROUP BY lemma HAVING count(*) >= 2)")
def join_wordgroups(s, d):
    groups = table(s, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("form")).distinct()
    return wordgraph.join_groups(groups, table(s, d, "part").select(F.col("p_partkey").alias("form"), F.col("p_type").alias("lemma")))


@query("SELECT p_partkey AS form, p_type AS lemma FROM part WHERE p_type IN (SELECT p_type FROM part GROUP BY p_type HAVING count(*) > 1)")
def join_lonewords(s, d):
    part = table(s, d, "part")
    return wordgraph.join_lone_words(part.select(F.col("p_partkey").alias("form")), part.select(F.col("p_partkey").alias("form"), F.col("p_type").alias("lemma")))


# --- evaluation (E1-E17): passages derived from events


def _spans(s, d, kinds: str, shift: int):
    e = table(s, d, "events").where(kinds)
    return e.select((F.col("event_id") % 97).alias("match_id"), (F.col("user_id") % 50).cast("string").alias("docid"), (F.col("event_id") % 1000 + shift).alias("start"), (F.col("event_id") % 1000 + shift + 30 + F.col("user_id") % 40).alias("end")).distinct()


def _sql_spans(name: str, kinds: str, shift: int) -> str:
    return f"{name} AS (SELECT DISTINCT event_id % 97 AS match_id, CAST(user_id % 50 AS VARCHAR) AS docid, event_id % 1000 + {shift} AS s, event_id % 1000 + {shift} + 30 + user_id % 40 AS e FROM events WHERE {kinds})"


#: Every event is a passage: those of types before f of the gold, the others (and those without a type) of the test.
_KINDS = ("event_type < 'f'", "coalesce(event_type, 'f') >= 'f'")
_EV = "WITH " + _sql_spans("go", _KINDS[0], 0) + ", " + _sql_spans("te", _KINDS[1], 7) + ", o AS (SELECT g.match_id AS g, t.match_id AS t, docid, g.s AS gs, g.e AS ge, t.s AS ts, t.e AS tee FROM go g JOIN te t USING (docid) WHERE g.s <= t.e AND t.s <= g.e), i AS (SELECT g, t FROM o GROUP BY g, t HAVING count(DISTINCT docid) > 1)"
_PRF = "round(r, 6) AS r, round(p, 6) AS p, round(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END, 6) AS f"


def _gold_test(s, d):
    return _spans(s, d, _KINDS[0], 0), _spans(s, d, _KINDS[1], 7)


@query(_EV + " SELECT g, t, docid, gs, ge, ts, tee AS te FROM o")
def passage_overlap(s, d):
    return matches.overlaps(*_gold_test(s, d)).select("g", "t", "docid", "gs", "ge", "ts", "te")


@query(_EV + " SELECT g, t FROM i")
def identical_matches(s, d):
    return matches.identical(*_gold_test(s, d))


@query(_EV + " SELECT DISTINCT g AS match_id FROM i")
def has_match(s, d):
    return matches.has_match(*_gold_test(s, d))


@query(_EV + " SELECT g, min(t) AS t FROM i GROUP BY g")
def recall_list(s, d):
    return matches.recall_list(*_gold_test(s, d))


@query(_EV + f", x AS (SELECT (SELECT count(DISTINCT g) FROM i) / (SELECT count(DISTINCT match_id) FROM go) AS r, (SELECT count(DISTINCT t) FROM i) / (SELECT count(DISTINCT match_id) FROM te) AS p) SELECT {_PRF} FROM x")
def f_match(s, d):
    return matches.score_matches(*_gold_test(s, d))


@query(_EV + f""", j AS (SELECT o.* FROM o JOIN i USING (g, t)), gp AS (SELECT DISTINCT docid, gs, ge FROM j), tp AS (SELECT DISTINCT docid, ts, tee FROM j),
gx AS (SELECT DISTINCT docid, gs, ge, unnest(range(greatest(gs, ts), least(ge, tee) + 1)) AS c FROM j), tx AS (SELECT DISTINCT docid, ts, tee, unnest(range(greatest(gs, ts), least(ge, tee) + 1)) AS c FROM j),
x AS (SELECT (SELECT count(*) FROM gx) / (SELECT sum(ge - gs + 1) FROM gp) AS r, (SELECT count(*) FROM tx) / (SELECT sum(tee - ts + 1) FROM tp) AS p) SELECT {_PRF} FROM x""")
def f_char(s, d):
    return matches.score_characters(*_gold_test(s, d))


@query(_EV + f""", j AS (SELECT o.* FROM o JOIN i USING (g, t)), x AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT docid, gs, ge FROM j)) / (SELECT count(*) FROM go WHERE match_id IN (SELECT g FROM i)) AS r,
(SELECT count(*) FROM (SELECT DISTINCT docid, ts, tee FROM j)) / (SELECT count(*) FROM te WHERE match_id IN (SELECT t FROM i)) AS p) SELECT {_PRF} FROM x""")
def f_cluster(s, d):
    return matches.score_clusters(*_gold_test(s, d))


@query(_EV + """, h AS (SELECT o.g, o.t, sum(least(ge, tee) - greatest(gs, ts)) AS n FROM o JOIN i USING (g, t) GROUP BY o.g, o.t), x AS (SELECT g, t, n / (SELECT sum(e - s) FROM go WHERE match_id = g) AS r, n / (SELECT sum(e - s) FROM te WHERE match_id = t) AS p FROM h)
SELECT g, t, round(r, 6) AS r, round(p, 6) AS p, round(CASE WHEN r + p > 0 THEN 2 * r * p / (p + r) ELSE 0 END, 6) AS f FROM x""")
def pair_overlap_prf(s, d):
    return matches.pair_overlap(*_gold_test(s, d))


@query(_EV + " SELECT g, t, round(count(*) / max(k), 6) AS precision FROM (SELECT DISTINCT g, t, docid, ts, tee FROM o) JOIN (SELECT match_id AS t, count(*) AS k FROM te GROUP BY 1) USING (t) GROUP BY g, t")
def pair_precision(s, d):
    return matches.pair_precision(*_gold_test(s, d))


@query("SELECT doc_id AS match_id, doc_id AS docid, doc_id % 50 AS \"start\", doc_id % 50 + doc_id % 7 AS \"end\", substr(text, doc_id % 50 + 1, doc_id % 7 + 1) AS passage FROM documents")
def readable_passages(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("docid"), "text")
    spans = docs.select(F.col("docid").alias("match_id"), "docid", (F.col("docid") % 50).alias("start"), (F.col("docid") % 50 + F.col("docid") % 7).alias("end"))
    return matches.readable(spans, docs)


def _marked(s, d):
    """Orders as annotated rows: one segment a row, matched to that of another order."""
    o = table(s, d, "orders")
    seg = F.concat(F.lit("s"), F.col("o_orderkey"))
    to = F.concat(F.lit("s"), (F.col("o_orderkey") % 100 + 1).cast("string"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "literal").when(F.col("o_orderkey") % 3 == 1, "weak-literal").otherwise("free")
    return o.select(F.col("o_custkey").cast("string").alias("docid"), F.col("o_orderkey").alias("row_idx"), F.concat(F.lit("ab$segstart_"), seg, F.lit("_"), kind, F.lit("_"), to, F.lit("$"), F.col("o_orderpriority"), F.lit("$segend_"), seg, F.lit("$ef")).alias("text"))


_SEGS = "sg AS (SELECT CAST(o_custkey AS VARCHAR) AS docid, 's' || o_orderkey AS seg, CASE o_orderkey % 3 WHEN 0 THEN 'literal' WHEN 1 THEN 'weak-literal' ELSE 'free' END AS type, 's' || (o_orderkey % 100 + 1) AS corresp, 2 AS s, 1 + length(o_orderpriority) AS e, o_orderpriority AS text FROM orders)"


@query(f"WITH {_SEGS} SELECT docid, seg, type, corresp, CAST(s AS BIGINT) AS \"start\", CAST(e AS BIGINT) AS \"end\", text FROM sg")
def parse_segments(s, d):
    return matches.parse_segments(_marked(s, d))


_LINES = "ln AS (SELECT l_orderkey, l_returnflag || l_linestatus || l_linenumber AS x, row_number() OVER o AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))"


@query(f"WITH {_LINES} SELECT CAST(l_orderkey AS VARCHAR) AS docid, 's' || l_orderkey AS seg, 'free' AS type, 't' || l_orderkey AS corresp, CASE WHEN i = 1 THEN 2 ELSE 0 END::BIGINT AS \"start\", (CASE WHEN i = 1 THEN 2 ELSE 0 END + length(x) - 1)::BIGINT AS \"end\", x AS text FROM ln")
def parse_segments_over_rows(s, d):
    """A segment opens in the first line of an order and closes in its last."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(s, d, "lineitem").withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey")))
    key, x = F.col("l_orderkey").cast("string"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    head = F.when(F.col("i") == 1, F.concat(F.lit("ab$segstart_s"), key, F.lit("_free_t"), key, F.lit("$"))).otherwise("")
    tail = F.when(F.col("i") == F.col("n"), F.concat(F.lit("$segend_s"), key, F.lit("$ef"))).otherwise("")
    return matches.parse_segments(rows.select(key.alias("docid"), F.col("i").alias("row_idx"), F.concat(head, x, tail).alias("text")))


@query(f"WITH {_SEGS}, c AS (SELECT b.seg || '-' || a.seg AS match_id, a.type, unnest([b.seg, a.seg]) AS seg FROM sg a JOIN sg b ON b.seg = a.corresp) SELECT match_id, c.type, CASE WHEN c.type IN ('literal', 'weak-literal') THEN c.type ELSE 'other' END AS class, docid, CAST(s AS BIGINT) AS \"start\", CAST(e AS BIGINT) AS \"end\" FROM c JOIN sg USING (seg)")
def gold_matches(s, d):
    return matches.gold_split(matches.gold_matches(matches.parse_segments(_marked(s, d)))).select("match_id", "type", "class", "docid", "start", "end")


@query("SELECT p_brand AS tool, p_partkey AS run_no, p_size AS goldmatch_no, CAST(p_partkey % 7 AS INTEGER) AS testmatch_no, p_retailprice AS time FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey % 7, p_retailprice, p_partkey) = 1")
def best_run(s, d):
    runs = table(s, d, "part").select(F.col("p_brand").alias("tool"), F.col("p_partkey").alias("run_no"), F.col("p_size").alias("goldmatch_no"), (F.col("p_partkey") % 7).cast("int").alias("testmatch_no"), F.col("p_retailprice").alias("time"))
    return matches.best_run(runs, "tool")


#: The parameter grids of the three detectors.
WINDOW_GRID = {"ngram": [3, 4], "gap": [1, 2, 3], "window": [5, 10], "in_docs": [2, 3, 4], "in_window": [2, 3, 4], "minimum": [2, 3, 4], "max_gap": [2, 3, 5], "banalities": [True, False]}
SEED_GRID = {"e_value": [1.0, 0.5, 0.1, 0.05, 0.01, 0.005, 0.001], "word_size": [3, 4, 5, 6, 7], "min_length": [15, 20, 30, 40]}
GRAM_GRID = {"n": [5, 7, 9], "min_match": [2], "max_df": [100], "beam": [20, 25, 30], "min_align": [20, 30, 50], "pcopy": [0.6, 0.7, 0.8]}
SEGMENT_GRID = {"n": [5, 7, 9], "min_match": [4, 5, 6], "max_df": [100, 300, 500], "min_align": [20, 30, 50], "pcopy": [0.6, 0.7, 0.8]}


def _grid_sql(axes: dict[str, list]) -> str:
    cast = lambda v: f"{v}::DOUBLE" if isinstance(v, float) else str(v).lower()
    return "SELECT * FROM " + ", ".join(f'unnest([{", ".join(map(cast, v))}]) t{i}("{k}")' for i, (k, v) in enumerate(axes.items()))


@query(_grid_sql(WINDOW_GRID) + ' WHERE ngram >= gap AND in_docs = in_window AND in_window = minimum AND max_gap <= "window"')
def param_grid(s, d):
    return matches.prune_grid(matches.grid(s, **WINDOW_GRID))


@query(_grid_sql(SEED_GRID))
def param_grid_seed(s, d):
    return matches.grid(s, **SEED_GRID)


@query(_grid_sql(GRAM_GRID))
def param_grid_gram(s, d):
    return matches.grid(s, **GRAM_GRID)


@query(_grid_sql(SEGMENT_GRID))
def param_grid_segments(s, d):
    return matches.grid(s, **SEGMENT_GRID)


_RUN_SIDES = "WITH " + _sql_spans("go", _KINDS[0], 0) + ", " + ", ".join(_sql_spans(f"t{i}", k, shift) for i, (k, shift) in enumerate(((_KINDS[1], 7), (_KINDS[0], 3)))) + """, te AS (SELECT 0 AS run_no, * FROM t0 UNION ALL SELECT 1, * FROM t1),
o AS (SELECT run_no, g.match_id AS g, t.match_id AS t, docid, g.s AS gs, g.e AS ge, t.s AS ts, t.e AS tee FROM go g JOIN te t USING (docid) WHERE g.s <= t.e AND t.s <= g.e),
i AS (SELECT run_no, g, t FROM o GROUP BY ALL HAVING count(DISTINCT docid) > 1), j AS (SELECT o.* FROM o JOIN i USING (run_no, g, t)),
m AS (SELECT run_no, count(DISTINCT g) / (SELECT count(DISTINCT match_id) FROM go) AS r_m, count(DISTINCT t) / any_value(n) AS p_m FROM i JOIN (SELECT run_no, count(DISTINCT match_id) AS n FROM te GROUP BY 1) USING (run_no) GROUP BY run_no),
gx AS (SELECT run_no, count(*) AS n FROM (SELECT DISTINCT run_no, docid, gs, ge, unnest(range(greatest(gs, ts), least(ge, tee) + 1)) FROM j) GROUP BY 1), gd AS (SELECT run_no, sum(ge - gs + 1) AS k, count(*) AS c FROM (SELECT DISTINCT run_no, docid, gs, ge FROM j) GROUP BY 1),
tx AS (SELECT run_no, count(*) AS n FROM (SELECT DISTINCT run_no, docid, ts, tee, unnest(range(greatest(gs, ts), least(ge, tee) + 1)) FROM j) GROUP BY 1), td AS (SELECT run_no, sum(tee - ts + 1) AS k, count(*) AS c FROM (SELECT DISTINCT run_no, docid, ts, tee FROM j) GROUP BY 1),
gc AS (SELECT run_no, count(*) AS k FROM (SELECT DISTINCT run_no, g FROM i) JOIN go ON match_id = g GROUP BY 1), tc AS (SELECT i.run_no, count(*) AS k FROM (SELECT DISTINCT run_no, t FROM i) i JOIN te ON match_id = t AND te.run_no = i.run_no GROUP BY 1),
x AS (SELECT run_no, r_m, p_m, gx.n / gd.k AS r_ch, tx.n / td.k AS p_ch, gd.c / gc.k AS r_cl, td.c / tc.k AS p_cl FROM m JOIN gx USING (run_no) JOIN gd USING (run_no) JOIN tx USING (run_no) JOIN td USING (run_no) JOIN gc USING (run_no) JOIN tc USING (run_no))
SELECT CAST(run_no AS INTEGER) AS run_no, """ + ", ".join(f"round(r_{v}, 6) AS r_{v}, round(p_{v}, 6) AS p_{v}, round(2 * r_{v} * p_{v} / (r_{v} + p_{v}), 6) AS f_{v}" for v in ("m", "ch", "cl")) + " FROM x"


@query(_RUN_SIDES)
def run_scores(s, d):
    """The passages of several runs scored in one plan."""
    gold, test = _gold_test(s, d)
    sides = [test, _spans(s, d, _KINDS[0], 3)]
    passages = None
    for no, p in enumerate(sides):
        p = p.select(F.lit(no).alias("run_no"), F.col("match_id").cast("string").alias("match_id"), "docid", "start", "end")
        passages = p if passages is None else passages.union(p)
    n = passages.groupBy("run_no").agg(F.count_distinct("match_id").alias("testmatch_no"))
    runs = n.select("run_no", F.lit("window").alias("tool"), F.lit("unnorm/full").alias("input"), "testmatch_no")
    out = drivers.score_runs(gold, drivers.Runs(runs, passages))
    return out.select("run_no", *[f"{c}_{v}" for v in ("m", "ch", "cl") for c in "rpf"])


@query()
def grid_scores(s, d):
    """Window alignment run with two settings over documents and benchmark, scored against the benchmark passages that a third finds."""
    docs = detect.tokenised(_series(s, d))
    gold = drivers.detect_passages("window", docs, "b", ngram=5, in_docs=10, minimum=10).withColumnRenamed("cluster", "match_id")
    settings = [{"ngram": 3, "window": w, "in_docs": 4, "in_window": 3, "minimum": 3, "max_gap": 5} for w in (5, 10)]
    gold = tables.written(gold, "gold")
    done = drivers.evaluate_runs({"unnorm/full": docs}, gold, [("window", p) for p in settings])
    return drivers.score_runs(gold, done).select("run_no", "tool", "seg", "norm", "lem", "testmatch_no", "goldmatch_no", *[f"{c}_{v}" for v in ("m", "ch", "cl") for c in "rpf"])


def _pages(s, d):
    """Conversations as rows of a corpus: a turn is a page, its lines are broken at line ends."""
    return table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("corpus"), F.lit("1").alias("bookpart"), F.lit("1").alias("paragraph"), F.col("turn").cast("int").alias("row_idx"), F.col("turn").cast("int").alias("page"), F.replace("text", F.lit("\n"), F.lit("#lb#")).alias("text"))


@query()
def prepared_corpus(s, d):
    """The three phases over conversations."""
    return drivers.clean_corpus(_pages(s, d))[0].select("corpus", "row_idx", "text")


@query("""WITH w AS (SELECT conv_id, unnest(string_split_regex(lower(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')), ' ')) AS word FROM conversations)
SELECT word, CAST(conv_id AS VARCHAR) AS docid, count(*) AS freq FROM w WHERE word <> '' GROUP BY ALL""")
def token_vocabulary(s, d):
    """V2: white-space tokens of rows without markers."""
    rows = _pages(s, d).withColumn("text", F.lower(F.regexp_replace(F.replace("text", F.lit("#lb#"), F.lit(" ")), "[^a-zA-Z]+", " ")))
    return drivers.whole_tokens(rows).groupBy("word", "docid").agg(F.count("*").alias("freq"))


@query()
def prepared_sentences(s, d):
    """Conversations cleaned, joined and cut into sentences."""
    return drivers.prepare(_pages(s, d))["unnorm", "sentences"].select("docid", "page", "text")


# --- reports and formats


def _scores(s, d):
    p = table(s, d, "part")
    unit = lambda a, m: (F.col("p_partkey") * a % m / F.lit(float(m))).alias
    cols = [unit(a, m)(f"{k}_{lv}") for a, m, k, lv in ((3, 101, "r", "m"), (5, 103, "p", "m"), (7, 107, "f", "m"), (11, 109, "r", "ch"), (13, 113, "p", "ch"), (17, 127, "f", "ch"), (19, 131, "r", "cl"), (23, 137, "p", "cl"), (29, 139, "f", "cl"))]
    return p.select(F.col("p_partkey").alias("run_no"), F.col("p_brand").alias("tool"), (F.col("p_partkey") % 3).cast("int").alias("seg"), (F.col("p_partkey") % 2).cast("int").alias("norm"), (F.col("p_partkey") % 4).cast("int").alias("lem"), *cols)


_UNITS = ", ".join(f"p_partkey * {a} % {m} / {m}.0::DOUBLE AS {c}" for a, m, c in ((3, 101, "r_m"), (5, 103, "p_m"), (7, 107, "f_m"), (11, 109, "r_ch"), (13, 113, "p_ch"), (17, 127, "f_ch"), (19, 131, "r_cl"), (23, 137, "p_cl"), (29, 139, "f_cl")))
_SC = f"WITH sc AS (SELECT p_partkey AS run_no, p_brand AS tool, CAST(p_partkey % 3 AS INTEGER) AS seg, CAST(p_partkey % 2 AS INTEGER) AS norm, CAST(p_partkey % 4 AS INTEGER) AS lem, {_UNITS} FROM part)"


@query(_SC + " SELECT seg, norm, lem, round(avg(f_m), 4) AS mean FROM sc GROUP BY seg, norm, lem")
def segment_means(s, d):
    return reports.segment_means(_scores(s, d), "f_m")


@query(_SC + " SELECT run_no, tool, f_ch, r_ch, p_ch FROM sc ORDER BY f_ch DESC, r_ch DESC, p_ch DESC, run_no LIMIT 10")
def highscores_level(s, d):
    return reports.highscores(_scores(s, d), "ch", 10).select("run_no", "tool", "f_ch", "r_ch", "p_ch")


@query(_SC + " SELECT run_no, tool FROM sc ORDER BY (f_m + f_ch + f_cl) / 3 DESC, (r_m + r_ch + r_cl) / 3 DESC, (p_m + p_ch + p_cl) / 3 DESC, run_no LIMIT 10")
def highscores_average(s, d):
    return reports.highscores(_scores(s, d), "av", 10).select("run_no", "tool")


@query(_SC + " SELECT tool, run_no, r_m, p_m FROM sc QUALIFY row_number() OVER (PARTITION BY tool ORDER BY r_m DESC, p_m DESC, run_no) = 1")
def highest_recall(s, d):
    return reports.highest_recall(_scores(s, d)).select("tool", "run_no", "r_m", "p_m")


@query("WITH f AS (SELECT o_orderstatus AS tool, o_custkey AS run_no, o_orderpriority AS goldmatch FROM orders) SELECT tool, goldmatch, round(100.0::DOUBLE * count(DISTINCT run_no) / (SELECT count(DISTINCT run_no) FROM f g WHERE g.tool = f.tool), 1) AS rate FROM f GROUP BY tool, goldmatch")
def detection_rate(s, d):
    found = table(s, d, "orders").select(F.col("o_orderstatus").alias("tool"), F.col("o_custkey").alias("run_no"), F.col("o_orderpriority").alias("goldmatch"))
    return reports.detection_rate(found, found.select("tool", "run_no"))


_HITS = "hi AS (SELECT l_orderkey AS cluster, l_returnflag || '_' || l_linenumber AS title, l_partkey AS pos FROM lineitem)"


def _cluster_hits(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("cluster"), F.concat_ws("_", "l_returnflag", "l_linenumber").alias("title"), F.col("l_partkey").alias("pos"))


@query(f"WITH {_HITS} SELECT * FROM hi WHERE cluster IN (SELECT cluster FROM hi GROUP BY cluster HAVING count(DISTINCT split_part(title, '_', 1)) > 1)")
def cluster_filter(s, d):
    return reports.filter_clusters(_cluster_hits(s, d))


@query(f"WITH {_HITS} SELECT cluster, string_agg(title || ':' || pos, ',' ORDER BY title, pos) AS matches FROM hi GROUP BY cluster")
def cluster_regroup(s, d):
    line = F.transform("matches", lambda m: F.concat_ws(":", m["title"], m["pos"].cast("string")))
    return reports.regroup(_cluster_hits(s, d)).select("cluster", F.array_join(line, ",").alias("matches"))


@query("SELECT 'docs-' || source || '-' || doc_id AS textid, CASE WHEN lang = 'en' THEN 'source' ELSE 'target' END AS side FROM documents")
def text_ids(s, d):
    rows = table(s, d, "documents").withColumn("name", F.lit("docs")).withColumn("corpus", F.col("lang"))
    return reports.source_target(reports.text_ids(rows, "name", "source", row="doc_id"), "en").select("textid", "side")


@query("""SELECT CAST(json_object('title', 'd', 'doc_id', 'd_' || doc_id, 'text', text) AS VARCHAR) AS value FROM documents UNION ALL SELECT CAST(json_object('id', 'd_' || doc_id, 'series', 'd', 'text', text) AS VARCHAR) FROM documents""")
def tool_inputs(s, d):
    """F2, F3, S12."""
    rows = table(s, d, "documents").select(F.concat(F.lit("d_"), F.col("doc_id")).alias("textid"), "text")
    return reports.seed_input(rows).union(reports.gram_input(rows))


# --- sources and sinks (S2-S11): written to the shared folder and read back


_SAME = "SELECT doc_id, md5(text) AS text_md5, source FROM documents"


def _kept(df):
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "source")


@query(_SAME)
def csv_roundtrip(s, d):
    """Quoted, multi-line cells."""
    path = tables.fresh_path(s, "csv")
    tables.write_csv(table(s, d, "documents").select("doc_id", "text", "source"), path, delimiter=";")
    return _kept(tables.read_csv(s, path, delimiter=";"))


@query(_SAME)
def json_lines_roundtrip(s, d):
    """JSON lines, gzip."""
    path = tables.fresh_path(s, "jsonl")
    tables.write_json(table(s, d, "documents").select("doc_id", "text", "source"), path, compression="gzip")
    return _kept(tables.read_json(s, path, schema="doc_id long, text string, source string", lines=True))


@query("SELECT item_id, md5(text) AS text_md5 FROM benchmark")
def json_roundtrip(s, d):
    """One JSON document, an array over several lines."""
    path = tables.fresh_path(s, "json")
    one = table(s, d, "benchmark").agg(F.to_json(F.collect_list(F.struct("item_id", "text")), {"pretty": "true"}).alias("value"))
    tables.write_text(one.select("value"), path)
    return tables.read_json(s, path, schema="item_id long, text string").select("item_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT md5(string_agg(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '|' ORDER BY item_id)) AS text_md5 FROM benchmark")
def text_roundtrip(s, d):
    """One file a text, read whole and stripped."""
    path = tables.fresh_path(s, "text")
    for part in range(2):  # written, then appended to
        tables.write_text(table(s, d, "benchmark").where(F.col("item_id") % 2 == part).select(F.concat(F.lit("  "), "item_id", F.lit("\t"), "text", F.lit("\n ")).alias("value")).repartition(64, "value"), path, append=part > 0)
    rows = tables.read_text(s, path).where("text <> ''").select(F.explode(F.split("text", r"\n \n(?=  \d+\t)")).alias("t"))
    rows = rows.select(F.regexp_extract("t", r"^\s*(\d+)\t", 1).cast("long").alias("id"), F.regexp_replace("t", r"^\s*\d+\t", "").alias("t"))
    rows = rows.select(F.struct("id", F.regexp_replace("t", r"^[ \t\n\r]+|[ \t\n\r]+$", "").alias("t")).alias("s"))
    return rows.agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["t"]), "|").cast("binary")).alias("text_md5"))


@query(f"WITH {_NODES} SELECT fa, fb, weight FROM e WHERE weight > 0")
def edges_from_csv(s, d):
    """A similarity table as edges."""
    path, n = tables.fresh_path(s, "sims"), tables.written(_nodes(s, d), "nodes")
    rows = _edges(s, d, n).join(n.toDF("src", "w1"), "src").join(n.toDF("dst", "w2"), "dst").select("w1", "w2", F.lit(1.0).alias("sim"), F.col("weight").alias("normsim"), F.lit("-").alias("alignx"), F.lit("-").alias("aligny"))
    own = n.select(F.col("form").alias("w1"), F.col("form").alias("w2"), F.lit(1.0).alias("sim"), F.lit(1.0).alias("normsim"), F.lit("-").alias("alignx"), F.lit("-").alias("aligny"))
    tables.write_csv(rows.union(own), path, header=False)
    got = tables.read_edges(s, path, n).join(n.toDF("src", "x"), "src").join(n.toDF("dst", "y"), "dst")
    return got.select(F.least("x", "y").alias("fa"), F.greatest("x", "y").alias("fb"), "weight")


@query(f"WITH {_NODES} SELECT form, com AS com_id FROM m")
def model_roundtrip(s, d):
    """Nodes, edges and communities of a model, saved and loaded."""
    path = tables.fresh_path(s, "model")
    tables.save_model(path, nodes=_nodes(s, d), edges=_edges(s, d), communities=_members(s, d))
    model = tables.load_model(s, path, "nodes", "edges", "communities")
    return model["communities"].join(model["nodes"], "id").select("form", "com_id")


@query(f"WITH {_VOC} SELECT word, docid, freq FROM v")
def vocab_load(s, d):
    """V6."""
    path = tables.fresh_path(s, "vocabulary")
    _vocab(s, d).write.parquet(path)
    return vocab.load(s, path)


# --- extraction (X1-X9) and structure of volumes


@query("SELECT p_partkey AS page, ceil(p_partkey / 2)::BIGINT || CASE WHEN p_partkey % 2 = 1 THEN 'r' ELSE 'v' END AS fol, 'A' || ceil(p_partkey / 2)::BIGINT || CASE WHEN p_partkey % 2 = 0 THEN 'v' ELSE 'r' END AS gathering FROM part")
def folio_numbers(s, d):
    """Part keys as pages of one gathering."""
    page = F.col("p_partkey")
    return table(s, d, "part").select(page.alias("page"), structure.folio(page).alias("fol"), extract.gathering_column(F.lit("A"), page).alias("gathering"))


#: 26 gatherings of 8 leaves, 26 of 6 and 11 of 6 with two letters: 860 pages.
_FORMULA = [("A", "Z", 8, False), ("a", "z", 6, False), ("a", "k", 6, True)]
_GATHERED = """CASE WHEN page BETWEEN 1 AND 416 THEN chr(CAST(65 + (page - 1) // 16 AS INTEGER)) WHEN page BETWEEN 417 AND 728 THEN chr(CAST(97 + (page - 417) // 12 AS INTEGER)) WHEN page BETWEEN 729 AND 860 THEN repeat(chr(CAST(97 + (page - 729) // 12 AS INTEGER)), 2) END AS gathering,
CASE WHEN page BETWEEN 1 AND 416 THEN (page - 1) % 16 + 1 WHEN page BETWEEN 417 AND 728 THEN (page - 417) % 12 + 1 WHEN page BETWEEN 729 AND 860 THEN (page - 729) % 12 + 1 END AS no"""


@query(f"SELECT page, gathering, CAST(no AS BIGINT) AS no FROM (SELECT page, {_GATHERED} FROM (SELECT p_partkey AS page FROM part)) WHERE gathering IS NOT NULL")
def gathering_table(s, d):
    """X11: the gatherings of part keys as pages."""
    return table(s, d, "part").select(F.col("p_partkey").alias("page")).join(structure.gathering_pages(s, _FORMULA), "page").select("page", "gathering", F.col("no").cast("long").alias("no"))


_WORDS = ["xii.", "van Keyser Karel", "the Coninck", "hie Parijs", "Roemsche Kuninck", "plain words stand here", "in Bisschof stad", "Vrancrijch", "iiij ab"]
_PAGED = """x AS (SELECT l_orderkey % 5 AS volume, l_orderkey AS o, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, l_tax > 0.04 AS hi, [{words}][CAST((l_partkey + l_linenumber) % 9 + 1 AS INTEGER)] AS text FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax)), p AS (SELECT *, dense_rank() OVER (PARTITION BY volume ORDER BY o) AS page FROM x), v AS (SELECT *, max(page) OVER (PARTITION BY volume) AS pages FROM p)""".replace("{words}", ", ".join(f"'{w}'" for w in _WORDS))


def _improved_sql() -> str:
    known = lambda name: "CASE WHEN page % 2 = 0 THEN {verso} ELSE {recto} END".format(**{side: f"regexp_matches(text, '{p[name]}')" if name in p else "false" for side, p in structure.HEADERS.items()})
    flags = {"num": r"length(text) <= 12 AND length(regexp_replace(text, '[ijvuxlcdm.\s]', '', 'g')) <= 3", **{k: known(f) for k, f in (("a", "first"), ("b", "first_again"), ("c", "second"), ("d", "second_again"))}}
    look = "f AS (SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in flags.items()) + " FROM v)"
    one = ", ".join(f"coalesce(bool_or({k}) FILTER (k = {i}), false) AS {k}{i}" for i in (1, 2, 3) for k in (*flags, "hi"))
    steps, last = [f"s0 AS (SELECT volume, page, {one}, -1 AS h0, -1 AS h1, -1 AS h2 FROM f GROUP BY volume, page)"], "s0"
    for i in (1, 2, 3):
        t0, t1, t2 = f"(h0 < 0 AND num{i})", f"((h1 < 0 AND a{i}) OR b{i})", f"((h2 < 0 AND c{i}) OR d{i})"
        steps.append(f"s{i} AS (SELECT * REPLACE (CASE WHEN {t0} THEN {i} ELSE h0 END AS h0, CASE WHEN NOT {t0} AND {t1} THEN {i} ELSE h1 END AS h1, CASE WHEN NOT {t0} AND NOT {t1} AND {t2} THEN {i} ELSE h2 END AS h2) FROM {last})")
        last = f"s{i}"
    font = "(h1 < 0 AND h2 < 0 AND ((h0 < 0 AND k = 1 AND hi1) OR (h0 = 1 AND k = 2 AND hi2)))"
    role = f"CASE WHEN k = n AND (n = 1 OR n > 3) AND page < pages AND num THEN 'signature' WHEN k > 3 OR n = 1 THEN 'text' WHEN k = h0 THEN 'pagination' WHEN k IN (h1, h2) OR k < greatest(h0, h1, h2) OR {font} THEN 'header' ELSE 'text' END"
    return f"""WITH {_PAGED}, {look}, {", ".join(steps)}, r AS (SELECT volume, o * 1000 + k AS line_no, page, {role} AS role, text, {_GATHERED} FROM f JOIN s3 USING (volume, page))
SELECT volume, line_no, page, ceil(page / 2)::BIGINT || CASE WHEN page % 2 = 1 THEN 'r' ELSE 'v' END AS fol, gathering, gathering || ceil(no / 2)::BIGINT || CASE WHEN no % 2 = 0 THEN 'v' ELSE 'r' END AS label, role, text FROM r"""


@query(_improved_sql())
def structural_improvement(s, d):
    """Orders are pages of five volumes, their items lines; some are set as headings."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax")
    text = F.get(F.array(*map(F.lit, _WORDS)), ((F.col("l_partkey") + F.col("l_linenumber")) % 9).cast("int"))
    rows = table(s, d, "lineitem").withColumn("k", F.row_number().over(w)).select((F.col("l_orderkey") % 5).alias("volume"), "l_orderkey", "k", F.col("k").cast("long").alias("n"), text.alias("text"), (F.col("l_tax") > 0.04).alias("heading"))
    lines = rows.select("volume", (F.col("l_orderkey") * 1000 + F.col("k")).alias("line_no"), F.lit("l").alias("kind"), "text", "heading")
    breaks = rows.where("k = 1").select("volume", (F.col("l_orderkey") * 1000).alias("line_no"), F.lit("pb").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("heading"))
    return structure.improve(lines.union(breaks), _FORMULA)


_OCR = """l AS (SELECT doc_id, i, w[i] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents))),
o AS (SELECT doc_id, i, CASE i % 5 WHEN 0 THEN '<l><azklein x="1">' || t || '</azklein></l>' WHEN 1 THEN '<l>a <azgross>' || t || '</azgross></l>' WHEN 2 THEN t WHEN 3 THEN '<p>' || t ELSE '<l>' || t || '</l>' END AS v FROM l)"""


def _spread_sql(v: str, h: str) -> str:
    return f"replace(replace(regexp_replace({v}, '<{h}[^>]*>|</{h}>', '', 'g'), '<l>', '<l><{h}>'), '</l>', '</{h}></l>')"


@query(f"""WITH {_OCR}, h AS (SELECT *, CASE WHEN contains(v, '<azklein') THEN {_spread_sql('v', 'azklein')} WHEN contains(v, '<azgross') THEN {_spread_sql('v', 'azgross')} ELSE v END AS z, regexp_matches(v, '^[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]*(<l>|<pb>|</?p>|</?lg>)') AS ours FROM o),
r AS (SELECT doc_id, i, CASE WHEN ours THEN replace(regexp_replace(z, '([aeiou])n ', '\\1~ ', 'g'), '<l></l>', '') ELSE v END AS value, ours FROM h) SELECT doc_id, CAST(i AS INTEGER) AS line_no, md5(value) AS value_md5 FROM r WHERE NOT ours OR value <> ''""")
def ocr_lines(s, d):
    """Lines of documents as lines of an OCR file, headings in two sizes, two rules."""
    t, i = F.col("t"), (F.col("k") + 1).alias("line_no")
    kinds = ((0, F.concat(F.lit('<l><azklein x="1">'), t, F.lit("</azklein></l>"))), (1, F.concat(F.lit("<l>a <azgross>"), t, F.lit("</azgross></l>"))), (2, t), (3, F.concat(F.lit("<p>"), t)), (4, F.concat(F.lit("<l>"), t, F.lit("</l>"))))
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "t"))
    value = F.coalesce(*[F.when((F.col("k") + 1) % 5 == r, v) for r, v in kinds])
    out = structure.prepare_lines(lines.select("doc_id", i, value.alias("value")), (("([aeiou])n ", "$1~ "), ("<l></l>", "")))
    return out.select("doc_id", "line_no", F.md5(F.col("value").cast("binary")).alias("value_md5"))


def _canonical_sql(text: str) -> str:
    for pattern, put in extract.SEGMENT_FORMS:
        put = "$$" if put.startswith("\\") else put.replace("$", "\\")
        text = f"regexp_replace({text}, '{pattern.replace('(?U)', '').replace(chr(92) + 's', _SPACE)}', '{put}', 'g')"
    return text


_AROUND = "regexp_replace(regexp_replace(text, '([.?:!)]+) ', '\\1$segend_{0}$ $segend_x$ ', 'g'), ' ([A-Z])', '  $segstart_{0}_free_a&b$  \\1', 'g')"


@query("SELECT doc_id, md5(" + _canonical_sql("'$segstart_z$ ' || " + _AROUND.replace("{0}", "' || doc_id || '") + " || ' $segend_z$'") + ") AS text_md5 FROM documents")
def canonical_markers(s, d):
    """Segments that begin at capitals and end behind punctuation, with white space around the markers."""
    key = F.col("doc_id").cast("string")
    text = F.regexp_replace("text", F.lit(r"([.?:!)]+) "), F.concat(F.lit(r"$1\$segend_"), key, F.lit(r"\$ \$segend_x\$ ")))
    text = F.regexp_replace(text, F.lit(" ([A-Z])"), F.concat(F.lit(r"  \$segstart_"), key, F.lit(r"_free_a&b\$  $1")))
    return table(s, d, "documents").select("doc_id", F.md5(extract.canonical_segments(F.concat(F.lit("$segstart_z$ "), text, F.lit(" $segend_z$"))).cast("binary")).alias("text_md5"))


@query()
def page_extract(s, d):
    return extract.extract_pages(table(s, d, "pages"))


_ODD = r"[\x00-\x1f\x{7f}-\x{9f}\x{2028}\x{2029}\x{fffe}\x{ffff}=$]"


def _tei(text):
    """A text as TEI: ten lines a gathering, five a page; corrected forms, broken words, other markup, chained segments, headers in pairs, notes."""

    def line(t, i):
        t, no = F.regexp_replace(t, _ODD, " "), lambda k: (i + k).cast("string")
        for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            t = F.replace(t, F.lit(mark), F.lit(name))
        by = lambda n, at, *parts: F.when(i % n == at, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise("")
        return F.concat(
            by(10, 0, '<gb n="G', F.floor(i / 10).cast("string"), '"/>'),
            by(5, 0, '<pb n="', F.floor(i / 5).cast("string"), 'r"/>'),
            by(10, 0, '<l><fw type="header" xml:id="h', no(0), '" next="#h', no(5), '">left ', no(0), "</fw></l>"),
            by(10, 5, '<l><fw type="header" xml:id="h', no(0), '" prev="#h', no(-5), '">right ', no(0), "</fw></l>"),
            by(5, 0, "<l><choice><orig>old</orig><reg>", t, "</reg></choice></l>"),
            by(5, 1, "<l>", t, '<pc type="syllabification">-</pc></l>'),
            by(5, 2, "<l><hi>", t, "</hi><figure>none</figure></l>"),
            by(5, 3, '<l><seg type="tr" subtype="free" corresp="#a #b" xml:id="s', no(0), '" next="#s', no(1), '">', t, "</seg></l>"),
            by(5, 4, '<l><seg type="tr" xml:id="s', no(0), '" prev="#s', no(-1), '">', t, "</seg></l>"),
            by(7, 3, "<note><quote><l>", no(0), "</l><l>cut</l></quote><quote>two</quote></note>"),
        )

    return F.concat(F.lit('<TEI><div n="1"><p n="2">'), F.array_join(F.transform(F.split(text, "\n"), line), ""), F.lit("</p></div></TEI>"))


@query(rf"""WITH l AS (SELECT doc_id, i - 1 AS i, (i - 1) // 5 AS q, regexp_replace(w[i], '{_ODD}', ' ', 'g') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents))),
b AS (SELECT doc_id, i, q, CASE i % 5 WHEN 3 THEN '$segstart_s' || i || '_free_a&b$' || t WHEN 4 THEN t || '$segend_s' || (i - 1) || '$' ELSE t END AS t FROM l),
c AS (SELECT doc_id, i, q, regexp_replace(regexp_replace(t, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS t, lead(i) OVER (PARTITION BY doc_id, q ORDER BY i) IS NULL AS final FROM b WHERE t <> '' OR i % 5 = 1),
j AS (SELECT doc_id, q, string_agg(t || CASE WHEN i % 5 <> 1 THEN '#lb#' WHEN final THEN '=' ELSE '' END, '' ORDER BY i) AS t FROM c GROUP BY doc_id, q),
a AS (SELECT doc_id, q, 'main' AS kind, 2 AS o, 0 AS i, t FROM j UNION ALL SELECT doc_id, q, 'meta', 0, i, 'left ' || (i - 5) || '#lb#right ' || i || '#lb#' FROM l WHERE i % 10 = 5 UNION ALL SELECT doc_id, q, 'meta', 1, i, i || '#lb#cut#lb#two#lb#' FROM l WHERE i % 7 = 3)
SELECT CAST(doc_id AS VARCHAR) AS docid, kind, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY q, o, i) - 1 AS INTEGER) AS row_idx, '1' AS bookpart, '2' AS paragraph, CAST(q + 1 AS INTEGER) AS page, q || 'r' AS fol, 'G' || (q // 2) || '1' || CASE WHEN q % 2 = 0 THEN 'r' ELSE 'v' END AS gathering, md5({_canonical_sql('t')}) AS text_md5 FROM a""")
def tei_extract(s, d):
    """X1-X9 over documents wrapped as TEI."""
    rows = extract.extract_tei(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("docid"), _tei(F.col("text")).alias("xml")))
    return rows.select("docid", "kind", "row_idx", "bookpart", "paragraph", "page", "fol", "gathering", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that share most word 5-grams."""
    return shared_gram_pairs(spark, sf_dir).orderBy(F.desc("shared"), "a", "b")
