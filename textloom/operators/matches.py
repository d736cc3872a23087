"""Evaluation of matches against gold passages.

A match set is passages(match_id, docid, start, end), one row a passage, end
inclusive. Overlap is an equi-join on docid with a range condition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources.tables import written

_MARK = re.compile(r"\$seg(start|end)_([A-Za-z0-9]+)(?:_([^_$]*)_([^$]*))?\$")
_SEGMENT = pa.schema([("docid", pa.string()), ("seg", pa.string()), ("type", pa.string()), ("corresp", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])
#: Segments of one Arrow batch on its way back.
SEGMENTS = 5000


def parse_segments(rows: DataFrame) -> DataFrame:
    """(docid, seg, type, corresp, start, end, text) of rows(docid, row_idx, text) with inline markers.

    An open segment goes on into the following rows of its document, one
    passage a row. Offsets are those of the text without markers. Rows are dealt
    out by document and sorted, and a task walks them in batches, so that neither
    many small documents nor a long one are groups of their own in Python.
    """
    dealt = rows.select("docid", "row_idx", "text").repartition("docid").sortWithinPartitions("docid", "row_idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, live = None, {}
        for batch in batches:
            out = []
            for docid, text in zip(batch.column("docid").to_pylist(), batch.column("text").to_pylist()):
                if docid != doc:
                    doc, live = docid, {}
                text = text or ""
                if "$seg" not in text:
                    out += [(docid, k, t, c, 0, len(text) - 1, text) for k, (t, c) in live.items() if text]
                    continue
                plain, at, begun = "", 0, dict.fromkeys(live, 0)
                for m in _MARK.finditer(text):
                    plain += text[at : m.start()]
                    at = m.end()
                    if m[1] == "start":
                        live[m[2]], begun[m[2]] = (m[3] or "", m[4] or ""), len(plain)
                    elif m[2] in live:
                        out.append((docid, m[2], *live.pop(m[2]), begun[m[2]], len(plain) - 1, plain[begun[m[2]] :]))
                plain += text[at:]
                out += [(docid, k, t, c, begun[k], len(plain) - 1, plain[begun[k] :]) for k, (t, c) in live.items() if begun[k] < len(plain)]
            for k in range(0, len(out), SEGMENTS):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + SEGMENTS]), _SEGMENT)], schema=_SEGMENT)

    return dealt.mapInArrow(run, "docid string, seg string, type string, corresp string, start long, end long, text string")


def gold_matches(segments: DataFrame) -> DataFrame:
    """(match_id, type, docid, start, end): a segment and each segment it corresponds to, joined by &.

    Segments are parsed once. Only those that others correspond to meet the
    others, so that one which many correspond to is few rows beside them.
    """
    segments = written(segments.select("docid", "seg", "type", "corresp", "start", "end"), "segments")
    each = segments.where("corresp <> ''").select(F.col("seg").alias("t"), "type", F.explode(F.split("corresp", "&")).alias("s"))
    meant = segments.join(each.select(F.col("s").alias("seg")).distinct(), "seg", "left_semi").select("seg", "docid", "start", "end")
    each = each.join(meant.select(F.col("seg").alias("s")).distinct(), "s").select(F.concat_ws("-", "s", "t").alias("match_id"), "type", "s", "t")
    sides = [each.select("match_id", "type", F.col(k).alias("seg")).join(df, "seg") for k, df in (("s", meant), ("t", segments.select("seg", "docid", "start", "end")))]
    return sides[0].unionByName(sides[1]).select("match_id", "type", "docid", "start", "end")


def gold_split(gold: DataFrame) -> DataFrame:
    """Class literal, weak-literal or other."""
    return gold.withColumn("class", F.when(F.col("type").isin("literal", "weak-literal"), F.col("type")).otherwise("other"))


#: Most characters of a stretch of a document; passages meet stretch by stretch, so that a long or hot document is many keys.
STRETCH = 1024


def stretch_of(passages: DataFrame) -> int:
    """A stretch about as long as the passages(start, end) are on average: what meets in one overlaps for the most part."""
    mean = passages.agg(F.avg(F.greatest(F.lit(1), F.col("end") - F.col("start") + 1))).first()[0] or 1
    return min(STRETCH, max(16, 1 << (int(mean) - 1).bit_length()))


def meeting(g: DataFrame, t: DataFrame, on: tuple[str, ...] = ("docid",), stretch: int = STRETCH) -> DataFrame:
    """Passages g(on, gs, ge, ...) and t(on, ts, te, ...) that overlap: each pair once, in the stretch where the overlap begins."""
    cut = lambda df, lo, hi: df.withColumn("stretch", F.explode(F.sequence(F.floor(F.col(lo) / stretch), F.floor(F.greatest(lo, hi) / stretch))))
    both = cut(g, "gs", "ge").join(cut(t, "ts", "te"), [*on, "stretch"]).where("gs <= te and ts <= ge")
    return both.where(F.col("stretch") == F.floor(F.greatest("gs", "ts") / stretch)).drop("stretch")


def merged(passages: DataFrame, *keys: str) -> DataFrame:
    """The characters that passages(keys, s, e) cover, as intervals (keys, lo, hi) of which no two touch."""
    rows = passages.where("s <= e").groupBy(*keys, "s").agg(F.max("e").alias("e"))
    w = Window.partitionBy(*keys).orderBy("s")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("s") <= before + 1, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*keys, "island").agg(F.min("s").alias("lo"), F.max("e").alias("hi")).drop("island")


def _inverted(*sides: DataFrame) -> bool:
    """Whether a passage ends before it starts: such ones cover nothing and meet as they are, not merged."""
    return any(not side.where(F.col("end") < F.col("start")).isEmpty() for side in sides)


def _gold(gold: DataFrame) -> DataFrame:
    return gold.select(F.col("match_id").alias("g"), "docid", F.col("start").alias("gs"), F.col("end").alias("ge"))


def _test(test: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return test.select(*by, F.col("match_id").alias("t"), "docid", F.col("start").alias("ts"), F.col("end").alias("te"))


def _sides(gold: DataFrame, test: DataFrame, by: tuple[str, ...] = (), stretch: int = STRETCH) -> DataFrame:
    return meeting(_gold(gold), _test(test, by), stretch=stretch)


def overlaps(gold: DataFrame, test: DataFrame) -> DataFrame:
    """E5: (g, t, docid, gs, ge, ts, te) of overlapping passages."""
    return _sides(gold, test, stretch=stretch_of(gold.select("start", "end").union(test.select("start", "end"))))


def common(gold: DataFrame, test: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, g, t, docid, lo, hi): the characters that a gold and a test match both cover.

    The passages of a match in a document are merged before they meet, so a pair of
    matches has as many rows as there are stretches in common, not as there are
    pairs of passages. by: columns of the test side that tell match sets apart.
    """
    g = merged(_gold(gold).withColumnsRenamed({"gs": "s", "ge": "e"}), "g", "docid").withColumnsRenamed({"lo": "gs", "hi": "ge"})
    t = merged(_test(test, by).withColumnsRenamed({"ts": "s", "te": "e"}), *by, "t", "docid").withColumnsRenamed({"lo": "ts", "hi": "te"})
    return meeting(g, t).select(*by, "g", "t", "docid", F.greatest("gs", "ts").alias("lo"), F.least("ge", "te").alias("hi"))


def _in_two(both: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return both.groupBy(*by, "g", "t").agg(F.count_distinct("docid").alias("docs")).where("docs > 1").select(*by, "g", "t")


def identical(gold: DataFrame, test: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, g, t): matches that overlap in two documents or more."""
    return _in_two(_sides(gold, test, by) if _inverted(gold, test) else common(gold, test, by), by)


def found(gold: DataFrame, test: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The identical matches (by, g, t), and of gold and of test the passages that overlap an identical match with what
    it covers of them: (by, docid, s, e, lo, hi), a passage of several matches once."""
    odd = _inverted(gold, test)
    both = _sides(gold, test, by) if odd else written(common(gold, test, by), "common")
    same = written(_in_two(both, by), "identical")
    both = both.join(same, [*by, "g", "t"])

    def part(side: DataFrame, key: str, s: str, e: str) -> DataFrame:
        own = tuple(c for c in by if c in side.columns)
        if odd:
            o = both.withColumns({"lo": F.greatest("gs", "ts"), "hi": F.least("ge", "te")})
        else:
            cover = merged(both.select(*by, key, "docid", F.col("lo").alias("s"), F.col("hi").alias("e")), *by, key, "docid")
            o = meeting(side.withColumnsRenamed({s: "gs", e: "ge"}), cover.withColumnsRenamed({"lo": "ts", "hi": "te"}), (*own, key, "docid"))
            o = o.select(*by, "docid", F.col("gs").alias(s), F.col("ge").alias(e), F.greatest("gs", "ts").alias("lo"), F.least("ge", "te").alias("hi"))
        return o.select(*by, "docid", F.col(s).alias("s"), F.col(e).alias("e"), "lo", "hi").distinct()

    return same, part(_gold(gold), "g", "gs", "ge"), part(_test(test, by), "t", "ts", "te")


def has_match(gold: DataFrame, test: DataFrame) -> DataFrame:
    """The matches of gold that have an identical one."""
    return gold.select("match_id").distinct().join(identical(gold, test).select(F.col("g").alias("match_id")), "match_id", "left_semi")


def recall_list(gold: DataFrame, test: DataFrame) -> DataFrame:
    """Each gold match with its first identical test match."""
    return identical(gold, test).groupBy("g").agg(F.min("t").alias("t"))


def _f(r: Column, p: Column) -> Column:
    return F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(0.0)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _prf(row: DataFrame, gn: str, gd: str, tn: str, td: str) -> DataFrame:
    out = row.select(_ratio(F.col(gn), F.col(gd)).alias("r"), _ratio(F.col(tn), F.col(td)).alias("p"))
    return out.select(F.round("r", 6).alias("r"), F.round("p", 6).alias("p"), F.round(_f(F.col("r"), F.col("p")), 6).alias("f"))


def score_matches(gold: DataFrame, test: DataFrame) -> DataFrame:
    """Match-level recall, precision and F (0 where undefined)."""
    same = identical(gold, test).agg(F.count_distinct("g").alias("gn"), F.count_distinct("t").alias("tn"))
    row = same.crossJoin(gold.agg(F.count_distinct("match_id").alias("gd"))).crossJoin(test.agg(F.count_distinct("match_id").alias("td")))
    return _prf(row, "gn", "gd", "tn", "td")


def covered(pieces: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """pieces(by, docid, s, e, lo, hi): covered length of each passage (by, docid, s, e), by merging intervals."""
    w = Window.partitionBy(*by, "docid", "s", "e").orderBy("lo", "hi")
    upto = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return pieces.withColumn("add", F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce(upto + 1, F.col("lo"))) + 1)).groupBy(*by, "docid", "s", "e").agg(F.sum("add").alias("covered"))


def score_characters(gold: DataFrame, test: DataFrame) -> DataFrame:
    """Character-level scores over identical match pairs; a passage counts once."""
    _, g, t = found(gold, test)
    part = lambda side, k: covered(side).agg(F.coalesce(F.sum("covered"), F.lit(0)).alias(f"{k}n"), F.coalesce(F.sum(F.col("e") - F.col("s") + 1), F.lit(0)).alias(f"{k}d"))
    return _prf(part(g, "g").crossJoin(part(t, "t")), "gn", "gd", "tn", "td")


def score_clusters(gold: DataFrame, test: DataFrame) -> DataFrame:
    """Passages overlapped (once) over passages of the detected matches (once a match)."""
    same, *hits = found(gold, test)

    def part(side: DataFrame, hit: DataFrame, key: str) -> DataFrame:
        every = side.join(same.select(F.col(key).alias("match_id")).distinct(), "match_id").agg(F.count("*").alias(f"{key}d"))
        return hit.select("docid", "s", "e").distinct().agg(F.count("*").alias(f"{key}n")).crossJoin(every)

    return _prf(part(gold, hits[0], "g").crossJoin(part(test, hits[1], "t")), "gn", "gd", "tn", "td")


def _profile(passages: DataFrame, key: str, count: str) -> DataFrame:
    """passages(key, docid, s, e) as (key, docid, at, count): how many of them hold a character behind their first one."""
    steps = passages.where("s < e").select(key, "docid", F.explode(F.array(F.struct((F.col("s") + 1).alias("at"), F.lit(1).alias("d")), F.struct((F.col("e") + 1).alias("at"), F.lit(-1).alias("d")))).alias("x"))
    steps = steps.groupBy(key, "docid", "x.at").agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy(key, "docid").orderBy("at")
    runs = steps.withColumn(count, F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("upto", F.lead("at").over(w) - 1)
    return runs.where(F.col(count) > 0).select(key, "docid", F.explode(F.sequence("at", "upto")).alias("at"), count)


def pair_overlap(gold: DataFrame, test: DataFrame, beta: float = 1.0) -> DataFrame:
    """Recall, precision and F-beta of each identical pair; lengths are exclusive (end - start).

    The overlaps of all passages of a pair add up to the products, character by
    character, of how many passages of either match hold it behind their first
    one, so passages never meet one by one.
    """
    if _inverted(gold, test):
        o = _sides(gold, test).join(identical(gold, test), ["g", "t"])
        hit = o.groupBy("g", "t").agg(F.sum(F.least("ge", "te") - F.greatest("gs", "ts")).alias("n"))
    else:
        g, t = (_profile(side.withColumnsRenamed({f"{k}s": "s", f"{k}e": "e"}), k, f"n{k}") for side, k in ((_gold(gold), "g"), (_test(test), "t")))
        n = g.join(t, ["docid", "at"]).groupBy("g", "t").agg(F.sum(F.col("ng") * F.col("nt")).alias("n"))
        hit = identical(gold, test).where("g is not null and t is not null").join(n, ["g", "t"], "left").fillna(0, ["n"])
    size = lambda d, k: d.groupBy(F.col("match_id").alias(k)).agg(F.sum(F.col("end") - F.col("start")).alias(f"len_{k}"))
    rows = hit.join(size(gold, "g"), "g").join(size(test, "t"), "t")
    r, p, b = _ratio(F.col("n"), F.col("len_g")), _ratio(F.col("n"), F.col("len_t")), beta * beta
    return rows.select("g", "t", F.round(r, 6).alias("r"), F.round(p, 6).alias("p"), F.round(F.when(r + p > 0, (1 + b) * r * p / (b * p + r)).otherwise(0.0), 6).alias("f"))


def pair_precision(gold: DataFrame, test: DataFrame) -> DataFrame:
    """Share of a test match's passages that overlap the gold match.

    A passage meets the merged passages of a gold match and counts at the first
    that it overlaps.
    """
    each = test.distinct()
    if _inverted(gold, test):
        hit = _sides(gold, test).select("g", "t", "docid", "ts", "te").distinct()
    else:
        g = merged(_gold(gold).withColumnsRenamed({"gs": "s", "ge": "e"}), "g", "docid")
        g = g.withColumn("before", F.lag("hi").over(Window.partitionBy("g", "docid").orderBy("lo")))
        hit = meeting(g.withColumnsRenamed({"lo": "gs", "hi": "ge"}), _test(test).distinct(), stretch=stretch_of(test)).where("before is null or before < ts")
    size = each.groupBy(F.col("match_id").alias("t")).agg(F.count("*").alias("k"))
    return hit.groupBy("g", "t").agg(F.count("*").alias("n")).join(size, "t").select("g", "t", F.round(F.col("n") / F.col("k"), 6).alias("precision"))


def readable(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """Passages with the text they cover."""
    return passages.join(docs.select("docid", "text"), "docid").select("match_id", "docid", "start", "end", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start") + 1).alias("passage"))


def best_run(runs: DataFrame, *keys: str) -> DataFrame:
    """Most gold matches, then fewest test matches, then least time, then first run (within keys)."""
    order = Window.partitionBy(*keys).orderBy(F.desc("goldmatch_no"), "testmatch_no", "time", "run_no")
    return runs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r") if keys else runs.orderBy(F.desc("goldmatch_no"), "testmatch_no", "time", "run_no").limit(1)


def grid(spark, **axes: list) -> DataFrame:
    """The cartesian grid of parameter values, one column an axis."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def prune_grid(configs: DataFrame) -> DataFrame:
    """Rules for window-alignment grids."""
    return configs.where("ngram >= gap and in_docs = in_window and in_window = minimum and max_gap <= window")
