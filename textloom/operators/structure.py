"""Structure of scanned volumes (X10-X13): headings of the OCR, folios, gatherings, headers, paginations and signatures.

A volume is rows, not a file: lines(volume, line_no, kind, text, heading), kind pb
for a page break and l for a line, line_no a whole number that is unique in its
volume. Nothing walks a volume: page numbers are running sums over stretches of
lines, pages are partitions of a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.extract import gathering_column

#: Lines whose page breaks are counted together.
STRETCH = 1 << 16

#: Words by which the headers of left (verso) and right (recto) pages are known. The first header is the
#: first line with `first`, or any with `first_again`; likewise the second.
HEADERS = {
    "verso": {
        "first": r"[Kk]?[ae][ijy]{1,2}[sß]er?",
        "first_again": r"[rR]oe?mi?sch(e|er)? ?[Kk]?[ou]n[ijy]{1,2}n([gkc]|ck)",
        "second": r"[Kk]?[ou]n[ijy]{1,2}n([gkc]|ck)",
        "second_again": r"[vVuUfF]ranc?krij?ch",
    },
    "recto": {"first": r"[Pp]a[ijy]{1,2}[sß]", "second": r"[Bb]?[ijyu]{1,2}ss?ch[ou](ff?|[uv]e?)"},
}


def prepare_lines(lines: DataFrame, rules: tuple[tuple[str, str], ...] = (), headings: tuple[str, ...] = ("azklein", "azgross")) -> DataFrame:
    """lines(value, ...) of an OCR file: a heading tag takes its whole line, rules(regex, replacement) follow in order.

    Only lines that begin with <l>, <pb>, <p> or <lg> are touched; of these, empty
    ones go. Null stays null.
    """
    value, bare = F.col("value"), lambda h: F.regexp_replace("value", f"<{h}[^>]*>|</{h}>", "")
    out = value
    for h in reversed(headings):  # the first of them that a line holds counts
        wide = F.replace(F.replace(bare(h), F.lit("<l>"), F.lit(f"<l><{h}>")), F.lit("</l>"), F.lit(f"</{h}></l>"))
        out = F.when(F.contains(value, F.lit(f"<{h}")), wide).otherwise(out)
    for regex, put in rules:
        out = F.regexp_replace(out, regex, put)
    ours = F.coalesce(value.rlike(r"(?U)^\s*(<l>|<pb>|</?p>|</?lg>)"), F.lit(False))
    return lines.withColumn("_ours", ours).withColumn("value", F.when(ours, out).otherwise(value)).where(~F.col("_ours") | F.col("value").rlike(r"(?U)\S")).drop("_ours")


def gathering_pages(spark: SparkSession, formula: list[tuple[str, str, int, bool]]) -> DataFrame:
    """X11: (page, gathering, no) of a formula (first letter, last letter, leaves, doubled); a leaf has two pages.

    The formula is a parameter like a rule table: its rows are pages of one volume.
    """
    ranges = spark.createDataFrame([(k, *f) for k, f in enumerate(formula)], "ord int, first string, last string, leaves int, doubled boolean")
    letters = ranges.select("ord", "leaves", "doubled", F.explode(F.sequence(F.ascii("first"), F.ascii("last"))).alias("c"))
    name = F.repeat(F.char("c"), F.when(F.col("doubled"), 2).otherwise(1))
    upto = F.sum(F.col("leaves") * 2).over(Window.orderBy("ord", "c").rowsBetween(Window.unboundedPreceding, -1))  # rows of a formula
    table = letters.select(name.alias("gathering"), "leaves", F.coalesce(upto, F.lit(0)).alias("before"))
    return table.select("gathering", "before", F.explode(F.sequence(F.lit(1), F.col("leaves") * 2)).alias("no")).select((F.col("before") + F.col("no")).alias("page"), "gathering", "no")


def folio(page: Column) -> Column:
    """1r, 1v, 2r of pages 1, 2, 3."""
    return F.concat(F.ceil(page / 2).cast("string"), F.when(page % 2 == 1, "r").otherwise("v"))


def number_pages(lines: DataFrame) -> DataFrame:
    """page (breaks up to and with the line, 0 before the first) and pages (of the volume)."""
    rows = lines.withColumn("_stretch", F.floor(F.col("line_no") / STRETCH))
    breaks = F.sum(F.when(F.col("kind") == "pb", 1).otherwise(0))
    sums, volume = rows.groupBy("volume", "_stretch").agg(breaks.alias("n")), Window.partitionBy("_volume")
    sums = sums.select(F.col("volume").alias("_volume"), F.col("_stretch").alias("_s"), "n")
    before = F.coalesce(F.sum("n").over(volume.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_volume", "_s", before.alias("_before"), F.sum("n").over(volume).alias("pages"))
    rows = rows.join(sums, F.col("volume").eqNullSafe(F.col("_volume")) & (F.col("_stretch") == F.col("_s")))
    inside = Window.partitionBy("volume", "_stretch").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("page", F.col("_before") + breaks.over(inside)).drop("_volume", "_s", "_stretch", "_before")


def numeral(text: Column) -> Column:
    """Short, and hardly anything but numerals: a pagination or a signature."""
    return (F.length(text) <= 12) & (F.length(F.regexp_replace(text, r"(?U)[ijvuxlcdm.\s]", "")) <= 3)


def header_roles(top: Column, page: Column, patterns: dict[str, dict[str, str]] = HEADERS) -> Column:
    """The roles (pagination, header, text) of the first lines, an array of (text, heading), of a page.

    A line is taken once, as pagination before first before second header. Where no
    words tell, the first line that is no pagination is a header if it is set as a
    heading; otherwise lines before the last one found are headers as well.
    """

    def known(name: str, text: Column) -> Column:
        has = lambda side: text.rlike(patterns[side][name]) if name in patterns[side] else F.lit(False)
        return F.when(page % 2 == 0, has("verso")).otherwise(has("recto"))

    def look(x: Column, i: Column) -> Column:
        text = F.coalesce(x["text"], F.lit(""))
        return F.struct(i.alias("i"), numeral(text).alias("numeral"), *[known(k, text).alias(k) for k in ("first", "first_again", "second", "second_again")])

    def step(found: Column, x: Column) -> Column:
        is_page = (found["page"] < 0) & x["numeral"]
        is_first = ~is_page & (((found["first"] < 0) & x["first"]) | x["first_again"])
        is_second = ~is_page & ~is_first & (((found["second"] < 0) & x["second"]) | x["second_again"])
        return F.struct(*[F.when(now, x["i"]).otherwise(found[k]).alias(k) for k, now in (("page", is_page), ("first", is_first), ("second", is_second))])

    none = F.struct(*[F.lit(-1).alias(k) for k in ("page", "first", "second")])

    def name(found: Column) -> Column:
        last = F.greatest(found["page"], found["first"], found["second"])
        words = (found["first"] >= 0) | (found["second"] >= 0)
        alone = found["page"] + 1  # the line after a pagination in the first line, or the first line
        by_font = ~words & (found["page"] <= 0) & F.coalesce(F.get(top, alone)["heading"], F.lit(False))
        header = lambda i: (i == found["first"]) | (i == found["second"]) | (i < last) | (by_font & (i == alone))
        return F.transform(top, lambda _, i: F.when(i == found["page"], "pagination").when(header(i), "header").otherwise("text"))

    return F.aggregate(F.transform(top, look), none, step, name)


def improve(lines: DataFrame, formula: list[tuple[str, str, int, bool]], patterns: dict[str, dict[str, str]] = HEADERS) -> DataFrame:
    """(volume, line_no, page, fol, gathering, label, role, text) of the lines; breaks go, every line stays.

    The first three lines of a page of two lines or more may be its pagination and
    headers (X13). The last line of a page of one line, or of more than three, is its
    signature if it looks like a numeral and another page follows. Lines before the
    first break are page 0. gathering and label are null beyond the formula. A page is
    one partition of a window.
    """
    rows, page = number_pages(lines), Window.partitionBy("volume", "page")
    line = F.when(F.col("kind") == "pb", 0).otherwise(1)
    rows = rows.withColumn("k", F.sum(line).over(page.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.sum(line).over(page))
    rows = rows.where("kind <> 'pb'")
    tops = [F.max(F.when(F.col("k") == i, F.struct("text", "heading"))).over(page).alias(f"_{i}") for i in (1, 2, 3)]
    rows = rows.select("volume", "line_no", "page", "pages", "k", "n", "text", *tops)
    top = F.array_compact(F.array("_1", "_2", "_3"))
    role = F.when((F.col("k") <= 3) & (F.col("n") > 1), F.get(header_roles(top, F.col("page"), patterns), (F.col("k") - 1).cast("int"))).otherwise("text")
    last = (F.col("k") == F.col("n")) & ((F.col("n") == 1) | (F.col("n") > 3)) & (F.col("page") < F.col("pages"))
    role = F.when(last & numeral(F.coalesce("text", F.lit(""))), "signature").otherwise(role)
    rows = rows.select("volume", "line_no", "page", role.alias("role"), "text")
    table = gathering_pages(lines.sparkSession, formula).withColumnRenamed("page", "_page")
    out = rows.join(table, F.col("page") == F.col("_page"), "left")
    return out.select("volume", "line_no", "page", folio(F.col("page")).alias("fol"), "gathering", gathering_column(F.col("gathering"), F.col("no")).alias("label"), "role", "text")
