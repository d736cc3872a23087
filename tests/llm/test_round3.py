"""Chat formatting, co-bucketing and fill-in-middle against brute force, on small odd tables."""

import datetime as dt
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textloom.llm import chat, cobucket, fill_in_middle as fim

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

TEXTS = [
    (1, "one two  three\nfour, 5 é日本😀 six"), (2, None), (3, ""), (4, "has <P> inside"), (5, "<<S> <"), (6, "a\x00b\r\n"), (7, "<<<P<S"), (8, "x" * 5000 + " " + "y é" * 3000), (9, "word"), (10, "."),
    (1, "one two  three\nfour, 5 é日本😀 six"), (None, "no id at all, though words"), (-7, "minus seven has words"), *((100 + k, f"text {k} < P> <" + "M S>" * (k % 3) + " tail é" * k) for k in range(120)),
]


def fim_by_hand(i, text):
    text = text or ""
    toks = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = sha(f"1:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(toks)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(toks[:lo]), "".join(toks[lo:hi]), "".join(toks[hi:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text, text
    if h4 % 100 < 20:
        return i, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}", text
    return i, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}", text


def test_fill_in_middle(spark):
    docs = spark.createDataFrame([(i, t, "n", k) for k, (i, t) in enumerate(TEXTS)], "doc_id long, text string, form string, h int")
    made = fim.restore(fim.transform(docs))
    assert made.columns == ["doc_id", "text", "h", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in made.orderBy("h").collect()]
    want = [fim_by_hand(*x) for x in TEXTS]
    assert got == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    told = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in fim.digests(docs).collect())
    assert told == Counter((*w[:5], sha(w[5]), sha(w[6])) for w in want)
    assert fim.digests(docs.limit(0)).count() == 0 and fim.transform(docs.limit(0)).count() == 0


def test_fill_in_middle_parameters(spark):
    docs = spark.createDataFrame([(k, f"some words of text {k} 'quoted'") for k in range(40)], "id long, body string")
    every = fim.restore(fim.transform(docs, id_col="id", text_col="body", marks=("'p>", "|s>", "{m}"), seed=7, plain_percent=0, spm_percent=100), marks=("'p>", "|s>", "{m}")).collect()
    assert all(r.form == "spm" and r.restored == r.body and r.output.startswith("|s>") for r in every)
    for marks in (("<P>", "<P>x", "<M>"), ("ab", "bc", "x"), ("", "a", "b"), ("aba", "x", "y"), ("a", "a", "b")):
        with pytest.raises(ValueError):
            fim.transform(docs, id_col="id", text_col="body", marks=marks)


CONVERSATIONS = {
    1: [(0, "system", "be <|im_end|> kind"), (1, "user", "hé"), (2, "assistant", "yes & <|im_start|>&amp; &lt;|"), (3, "user", None), (4, "assistant", "")],
    2: [(0, "user", "a"), (1, "user", "b")], 3: [(0, "assistant", "early"), (1, "user", "x")], 4: [(0, "system", "alone")], 5: [(0, None, "no role"), (1, "user", "x")], 6: [(None, "user", "first"), (0, "assistant", "second")],
    7: [(k, "user" if k % 2 == 0 else "assistant", f"turn {k} é😀") for k in range(300)], 8: [*((k, "user" if k % 2 == 0 else "assistant", "t") for k in range(200)), (200, "assistant", "twice"), (201, "tool", "x")],
    9: [(0, "user", "same"), (0, "user", "same"), (1, "assistant", "z")], 10: [(0, "a\nb<|&nl;", "odd role"), (1, "user", "<")], 11: [(0, "user", "|im_end|>"), (1, "assistant", "<"), (2, "user", "<<||")], None: [(0, "user", "q"), (1, "assistant", "r")],
}


def fold_by_hand(turns):
    """(valid, number of the turn at fault) by one plain pass."""
    state, t = chat.CHAT.first, chat.CHAT
    for n, role, _ in turns:
        state = t.moves[state].get(role or "")
        if state is None:
            return False, n
    return state in t.final, None


def test_chat(spark):
    rows = [(c, n, r, x, "k") for c, turns in CONVERSATIONS.items() for n, r, x in turns]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string").repartition(5)
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert set(got) == set(CONVERSATIONS)
    for c, turns in CONVERSATIONS.items():
        loss = "".join(x or "" for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r or ''}\n{x or ''}\n" for _, r, x in turns)), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
        assert (got[c].valid, got[c].fault_turn) == fold_by_hand(turns), c
    done = chat.format_conversations(df).withColumn("out", chat.rendered(F.col("segments"))).collect()
    for r in done:
        assert r.out.count("<|im_start|>") == r.out.count("<|im_end|>") == r.n_turns
        assert [s.loss for s in r.segments] == [loss for _, role, _ in CONVERSATIONS[r.conv_id] for loss in (False, role == "assistant", False)]
    assert chat.digests(df.limit(0)).count() == 0
    plan = chat.digests(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("== Physical Plan ==")[1])


def test_chat_template(spark):
    t = chat.Template(start="[[a]]", end="[[z]]", lead="[[", escapes=(("%", "%25"), ("[[", "%5B[")), role_escapes=(("\n", "%0A"),), loss_roles=("bot", "tool"), moves={"x": {"me": "y"}, "y": {"bot": "x", "tool": "y"}}, first="x", final=("x",))
    df = spark.createDataFrame([(1, 0, "me", "[[z]]%"), (1, 1, "tool", "[[["), (1, 2, "bot", "%5B["), (2, 0, "me", "")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(df, t).withColumn("back", chat.parsed(chat.rendered(F.col("segments")), t)).withColumn("loss", chat.under_loss(F.col("segments"), t)).collect()}
    assert [(x.role, x.text) for x in got[1].back] == [("me", "[[z]]%"), ("tool", "[[["), ("bot", "%5B[")] and got[1].loss == "[[[%5B["
    assert got[1].valid and not got[2].valid and got[2].fault_turn is None
    with pytest.raises(ValueError):
        chat.Template(end="</s>")
    with pytest.raises(ValueError):
        chat.Template(final=("nowhere",))


SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"


def order(row):
    """Nulls first, NaN last, -0.0 with 0.0, strings by bytes."""
    key = []
    for v in row:
        nan = isinstance(v, float) and math.isnan(v)
        key.append((0,) if v is None else (2,) if nan else (1, v.encode() if isinstance(v, str) else v + 0 if isinstance(v, float) else v))
    return key


def crc(salt, key, m):
    return zlib.crc32(f"{salt}{key}".encode()) % m


def tables(rnd, n):
    at = dt.datetime(2024, 1, 1)
    pick = lambda *x: rnd.choice(x)
    sales = [(rnd.choice([*range(n), None]), pick(1, 2, None), pick("é", "z", "", None), pick(0.0, -0.0, float("nan"), None, 1.5), pick(at, None), at + dt.timedelta(microseconds=rnd.randrange(3)), pick(1, None)) for _ in range(2 * n)]
    lines = [(rnd.choice([*range(0, 2 * n, 1), 7, 7, 7, 7, None]), pick(1, 2, None), pick(None, *range(n // 2)), pick(1, 2), pick(1, None), pick(-0.0, 0.0, 2.5), 0.1, pick("a", "B", None), pick(at, None)) for _ in range(6 * n)]
    return sales, lines + lines[: n // 2] + [(7, 1, 3, 1, 1, 0.0, 0.1, "a", at)] * 500


@pytest.mark.parametrize("n, buckets, rows", [(300, 30, 400), (12, 300, 100), (40, 3, 10_000)])
def test_co_bucket(spark, monkeypatch, n, buckets, rows):
    monkeypatch.setattr(cobucket, "RANGE_ROWS", rows)  # hot keys take several ranges
    monkeypatch.setattr(cobucket, "GROUP_ROWS", 97)
    sales, lines = tables(random.Random(n), n)
    got = cobucket.sales_and_lines(spark.createDataFrame(sales, SALES).repartition(3), spark.createDataFrame(lines, LINES).repartition(5), buckets=buckets).collect()
    ids = {s[0] for s in sales} - {None}
    home = lambda k, orphan: buckets + 1 if k is None else buckets if orphan and k not in ids else crc("line", k, buckets)
    want = {}
    for name, data, schema in (("sales", sales, SALES), ("sale_lines", lines, LINES)):
        final, start = defaultdict(list), defaultdict(list)
        for r in data:
            b = home(r[0], name == "sale_lines")
            s = (b - 1 if b % 3 == 1 else b) if name == "sales" else 0 if r[2] is None else crc("", r[2], buckets)
            final[b].append((*r, s))
            start[s].append(r)
        for b, members in final.items():
            members.sort(key=order)
            origin = Counter(r[-1] for r in members)
            stays = len(origin) == 1 and len(start[members[0][-1]]) == len(members)
            want[name, b] = [r[:-1] for r in members], ",".join(f"{s}:{c}" for s, c in sorted(origin.items())), stays, members[0][-1], schema
    assert {(r.table_name, r.bucket) for r in got} == set(want)
    assert {want[k][2] for k in want} == {True, False} or buckets == 3
    there = defaultdict(set)
    for r in got:
        members, origin, stays, s, schema = want[r.table_name, r.bucket]
        path = r.path.removeprefix("file://")
        there[path.rpartition("/")[0]].add(path.rpartition("/")[2])
        file = pq.read_table(path)
        assert file.column_names == [c.split()[0] for c in schema.split(", ")] == r.columns.split(",")
        assert [repr(tuple(x.values())) for x in file.to_pylist()] == [repr(x) for x in members] or [order(x.values()) for x in file.to_pylist()] == [order(x) for x in members]
        assert Counter(repr(tuple(x.values())) for x in file.to_pylist()) == Counter(map(repr, members))
        assert r.ids_sha256 == sha(",".join("" if x[0] is None else str(x[0]) for x in members)) and r.lineage_sha256 == sha(origin) and r.n_rows == len(members)
        assert r.rewritten is not stays and (f"start-{s:05d}" in path) is stays
        if r.bucket < buckets:
            a, b = (Counter(x[0] for x in want.get((t, r.bucket), [[]])[0]) for t in ("sales", "sale_lines"))
            assert r.n_joined == sum(a[k] * b[k] for k in a)
        else:
            assert r.n_joined == 0
    import os

    assert all(set(os.listdir(d)) == names for d, names in there.items())


def test_co_bucket_of_empty_tables(spark):
    sales, lines = spark.createDataFrame([], SALES), spark.createDataFrame([], LINES)
    assert cobucket.sales_and_lines(sales, lines).count() == 0
    one = spark.createDataFrame([(5, 1, 2, 1, 1, 0.0, 0.1, "a", None)], LINES)
    (r,) = cobucket.sales_and_lines(sales, one).collect()
    assert (r.table_name, r.bucket, r.n_rows, r.n_joined, r.rewritten) == ("sale_lines", 300, 1, 0, False)
