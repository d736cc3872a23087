"""Personal data: pattern spans, and terms that disclose the values they stand with.

Patterns give base spans (e-mail, IP address, card and phone numbers). Their
values are the protected entities. A term that stands in the documents of an
entity and hardly anywhere else tells a reader that entity even where the value
itself is gone. For an entity e and a term t, over all documents,

    P(e | t) = n(t, e) / n(t),    bits(t -> e) = log2(P(e | t) * N / n(e)).

A term discloses e if P(e | t) >= GENERALISE, bits >= BITS and n(t, e) >= SUPPORT;
in every document of e it is then generalised, or removed from P >= REMOVE.

Copies of one text are no evidence, for or against. n(t, e), n(t), n(e) and N are
therefore all counted in distinct contexts: four independent minimum shingles of
each document are taken, and the least of the four numbers of distinct values
counts. Near copies share these minima with a chance equal to their similarity.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm.shared import BROADCAST_ROWS, few, keyed, texts, written

KINDS = ("email", "ip", "card", "phone")
GENERALISE, REMOVE, BITS, SUPPORT = 0.6, 0.9, 6.0, 4

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where a run of digits does: the same matches, in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPANS = "array<struct<kind string, start int, end int>>"
_MIN = np.random.default_rng(5).integers(1, 2**62, 4, dtype=np.uint64) * K.U64(2) + K.U64(1)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, leftmost non-overlapping within each kind, by start and then kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:  # a local part is the whole run before an @, back to the last match
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def entity(kind: str, value: str) -> str:
    """One spelling for each protected value."""
    return f"{kind}:{value.lower() if kind == 'email' else re.sub('[^0-9.]' if kind == 'ip' else '[^0-9]', '', value)}"


def _contexts(h: np.ndarray) -> list[int]:
    grams = K.rolling(h, 3) if len(h) >= 3 else h
    return [int((grams * m).min().astype(np.int64)) for m in _MIN] if len(grams) else [0] * len(_MIN)


@K.trimmed
def _entities(iterator):
    """Documents with personal data: their entities and context minima."""
    for batch in iterator:
        ids, ents, keys = [], [], [[] for _ in _MIN]
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            spans = base_spans(t or "")
            if spans:
                data = np.frombuffer(t.encode(), np.uint8)
                h = K.words(data, np.array([0, len(data)]), lower=True)[0]
                ids.append(i)
                ents.append(sorted({entity(k, t[a:b]) for k, a, b in spans}))
                for k, v in zip(keys, _contexts(h)):
                    k.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ents, pa.list_(pa.string())), *(pa.array(k, pa.int64()) for k in keys)], ["key", "entities", "c0", "c1", "c2", "c3"])


def _free_terms(text: str, spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, end) of the terms of a text that lie outside spans; positions are code points."""
    raw = np.frombuffer(text.encode(), np.uint8)
    h, s, e, _ = K.words(raw, np.array([0, len(raw)]), lower=True, space=K.NOT_TERM)
    if len(text) < len(raw):
        point = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        s, e = point[s], point[e]
    cover = np.zeros(len(text) + 1, np.int64)
    for _, a, b in spans:
        cover[a] += 1
        cover[b] -= 1
    covered = np.r_[0, np.cumsum(np.cumsum(cover[:-1]) > 0)]
    ok = covered[s] == covered[e]
    return h[ok], s[ok], e[ok]


@K.trimmed
def _terms_of(iterator):
    for batch in iterator:
        keys = batch.column(0).to_pylist()
        owner, term = [], []
        for i, t in zip(keys, batch.column(1).to_pylist()):
            h = np.unique(_free_terms(t, base_spans(t))[0])
            owner.append(np.full(len(h), i, np.int64))
            term.append(h.view(np.int64))
        if owner:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(owner)), pa.array(np.concatenate(term))], ["key", "term"])


@K.trimmed
def _all_contexts(iterator):
    """The context minima of every document."""
    for batch in iterator:
        keys = []
        for lo, hi in K.batches(batch.column(1)):
            data, offs = K.flat(batch.column(1).slice(lo, hi - lo))
            h, _, _, at = K.words(data, offs, lower=True)
            keys += [_contexts(h[a:b]) for a, b in zip(at, at[1:])]
        yield _rows(np.array(keys, np.int64).reshape(-1, len(_MIN)).T)


def _rows(keys, **first):
    return pa.RecordBatch.from_arrays([*map(pa.array, first.values()), *(pa.array(k, pa.int64()) for k in keys)], [*first, *(f"c{i}" for i in range(len(_MIN)))])


def _by_term(column: pa.Array, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, number of its text) for each text and distinct term, sorted by term; context minima by text."""
    terms, owners, contexts = [], [], []
    for lo, hi in K.batches(column):
        data, offs = K.flat(column.slice(lo, hi - lo))
        term, _, _, of_term = K.words(data, offs, lower=True, space=K.NOT_TERM)
        word, _, _, of_word = K.words(data, offs, lower=True)
        for i in range(hi - lo):
            own = np.unique(term[of_term[i] : of_term[i + 1]])
            if among is not None:
                own = own[among[np.minimum(np.searchsorted(among, own), len(among) - 1)] == own] if len(among) else own[:0]
            terms.append(own)
            owners.append(np.full(len(own), lo + i, np.int32))
            contexts.append(_contexts(word[of_word[i] : of_word[i + 1]]) if len(own) else [0] * len(_MIN))
    term = np.concatenate(terms) if terms else np.zeros(0, np.uint64)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int32)
    order = np.argsort(term, kind="stable")
    return term[order], owner[order], np.array(contexts, np.int64).reshape(-1, len(_MIN))


@K.trimmed
def _contexts_at_least(iterator):
    """(term, its distinct contexts in one batch): the least of the four numbers, below that of all batches."""
    for batch in iterator:
        term, owner, contexts = _by_term(batch.column(1))
        new_term = np.r_[True, term[1:] != term[:-1]] if len(term) else np.zeros(0, bool)
        edge, group = np.flatnonzero(new_term), np.cumsum(new_term) - 1
        low = np.diff(np.r_[edge, len(term)])
        some = (low > 1)[group]  # a term of one text has one context
        many, of_text = group[some], owner[some]
        for i in range(len(_MIN)):
            if not len(many):
                break
            k = contexts[of_text, i]
            order = np.lexsort((k, many))
            k, g = k[order], many[order]
            new = np.r_[True, (k[1:] != k[:-1]) | (g[1:] != g[:-1])]
            apart = np.bincount(g[new], minlength=len(edge))
            low = np.where(apart > 0, np.minimum(low, apart), low)
        for lo in range(0, len(edge), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(term[edge[lo : lo + 100_000]].view(np.int64)), pa.array(low[lo : lo + 100_000], pa.int64())], ["term", "low"])


@K.trimmed
def _term_contexts(iterator, shared):
    """(term, context minima) of the wanted terms, each once a batch: repeats add nothing to a number of distinct values."""
    among = shared.value if shared else None
    for batch in iterator:
        term, owner, contexts = _by_term(batch.column(1), among)
        _, same = np.unique(contexts, axis=0, return_inverse=True)
        pair = np.lexsort((same.ravel()[owner], term))
        t, c = term[pair], same.ravel()[owner[pair]]
        keep = pair[np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])]] if len(pair) else pair
        for lo in range(0, len(keep), 100_000):
            some = keep[lo : lo + 100_000]
            yield _rows(contexts[owner[some]].T, term=term[some].view(np.int64))


@K.trimmed
def _spanned(iterator, sanitised: bool):
    kind_at = {k: i for i, k in enumerate((*KINDS, "term", "gone"))}
    for batch in iterator:
        out, clean = [], []
        for t, told in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            t = t or ""
            spans = base_spans(t)
            if told:
                level = {x["term"]: x["kind"] for x in told}
                h, s, e = _free_terms(t, spans)
                for j in np.flatnonzero(np.isin(h.view(np.int64), np.array(list(level), np.int64))):
                    spans.append((level[int(h[j].astype(np.int64))], int(s[j]), int(e[j])))
                spans.sort(key=lambda x: (x[1], kind_at[x[0]]))
            out.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            if sanitised:
                parts, at = [], 0
                for k, a, b in spans:
                    if b > at:
                        parts += [t[at:a], *([] if k == "gone" or a < at else [f"[{k.upper()}]"])]
                        at = b
                clean.append("".join(parts) + t[at:])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind), pa.array(clean if sanitised else [None] * len(out), pa.string())], ["doc_id", "spans", "sanitised"])


def disclosing_terms(docs: DataFrame, *, generalise: float = GENERALISE, remove: float = REMOVE, bits: float = BITS, support: int = SUPPORT) -> DataFrame:
    """key, told array<struct<term, kind>>: hashes of the terms to hide in documents(key, text); kind is term or gone.

    Keys are distinct and not null. Documents without personal data, null and
    empty texts tell nothing and have no row; an empty table gives no row.
    """
    spark = docs.sparkSession
    found = written(docs.mapInArrow(_entities, "key long, entities array<string>, c0 long, c1 long, c2 long, c3 long"), "entities")
    each = found.select("key", F.explode("entities").alias("entity"), "c0", "c1", "c2", "c3")
    known = written(each.groupBy("entity").agg(_apart().alias("n_e")).where(F.col("n_e") >= support), "known")
    holders = written(each.join(few(known), "entity"), "holders")
    ids = written(holders.select("key").distinct(), "ids")
    terms = docs.join(few(ids), "key", "left_semi").mapInArrow(_terms_of, "key long, term long")
    pairs = holders.join(terms, "key")
    pairs = written(pairs.groupBy("entity", "n_e", "term").agg(_apart().alias("n")).where(F.col("n") >= support), "pairs")
    # a term with more contexts in one batch than n / generalise has more in all: only the others are counted in full
    most = written(pairs.groupBy("term").agg(F.max("n").alias("most")), "most")
    low = docs.mapInArrow(_contexts_at_least, "term long, low long").join(few(most.select("term")), "term", "left_semi").groupBy("term").agg(F.max("low").alias("low"))
    wanted = written(most.join(low, "term").where(F.col("most") >= generalise * F.col("low")).select("term"), "terms")
    # up to BROADCAST_ROWS terms are picked out in the tasks, beyond that by a shuffle join
    small = wanted.count() <= BROADCAST_ROWS
    shared = spark.sparkContext.broadcast(np.sort(wanted.toPandas()["term"].to_numpy(np.int64).view(np.uint64))) if small else None
    rows = docs.mapInArrow(lambda it: _term_contexts(it, shared), "term long, c0 long, c1 long, c2 long, c3 long")
    if not small:
        rows = rows.join(wanted, "term", "left_semi")
    df = rows.groupBy("term").agg(_apart().alias("df"))
    everywhere = written(docs.mapInArrow(_all_contexts, "c0 long, c1 long, c2 long, c3 long"), "contexts")
    total = min(everywhere.select(f"c{i}").distinct().count() for i in range(len(_MIN)))
    told = pairs.join(df, "term").withColumn("p", F.col("n") / F.col("df")).where((F.col("p") >= generalise) & (F.log2(F.col("p") * total / F.col("n_e")) >= bits))
    told = holders.select("entity", "key").join(few(written(told.select("entity", "term", "p"), "told")), "entity")
    told = told.groupBy("key", "term").agg(F.when(F.max("p") >= remove, "gone").otherwise("term").alias("kind"))
    return told.groupBy("key").agg(F.collect_list(F.struct("term", "kind")).alias("told"))


def _apart():
    """The least of the four numbers of distinct context minima of a group."""
    return F.least(*[F.count_distinct(f"c{i}") for i in range(len(_MIN))])


def sanitise(docs: DataFrame, *, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>>, sanitised text of every document.

    kind is email, ip, card, phone (base spans), term (generalised) or gone
    (removed); positions are code points, end exclusive. In the sanitised text a
    span becomes [KIND], overlapping spans one mark, terms that go leave nothing.
    A null or empty text has no spans and an empty sanitised text. Rows whose ids
    are null or repeat are documents of their own; equal texts are evidence only
    once. The time of a text grows in proportion to its length. An empty table
    gives an empty result; other columns of docs are not read.
    """
    source, _ = keyed(texts(docs, id_col=id_col, text_col=text_col))
    told = written(disclosing_terms(source.select("key", "text"), **thresholds), "told")
    size = told.agg(F.coalesce(F.sum(F.size("told")), F.lit(0))).first()[0]
    return source.join(few(told, size), "key", "left").select("doc_id", "text", "told").mapInArrow(lambda it: _spanned(it, with_text), f"doc_id long, spans {_SPANS}, sanitised string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (as text), n_term."""
    found = sanitise(docs, with_text=False)
    is_base = lambda s: s["kind"].isin(*KINDS)
    line = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(line(F.filter("spans", is_base)).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~is_base(s))).cast("long").alias("n_term"))
