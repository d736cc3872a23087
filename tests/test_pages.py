"""The sink of one file a document."""

import os

from pyspark.sql import Row
from pyspark.sql import functions as F

from textloom.operators import reports
from textloom.sources import pages, tables

ROWS = [("Dk_1", "a/b", "first é\n text", "1490", 'say "x", y'), ("Dk_1", "..", None, None, ""), *((f"Kch_{k % 3}", f"p{k}", f"page {k}", "1499", f"t{k}") for k in range(40))]


def metadata(spark, path):
    return {r.filename: (r.year, r.title) for r in tables.read_csv(spark, path).collect()}


def test_round_trip(spark, tmp_path):
    pages.register(spark)
    df = spark.createDataFrame(ROWS, "corpus string, docid string, text string, year string, title string").repartition(4)
    df = reports.source_target(df.withColumn("corpus", F.split("corpus", "_")[0]), "Dk").drop("corpus")
    df.write.format("docfiles").option("path", str(tmp_path / "out")).mode("append").save()
    out = tmp_path / "out"
    assert sorted(os.listdir(out)) == ["source", "source_md", "target", "target_md"]
    assert (out / "source" / "a%2Fb.txt").read_bytes().decode() == "first é\n text" and (out / "source" / "%2E%2E.txt").read_text() == ""
    assert {n: (out / "target" / n).read_text() for n in os.listdir(out / "target")} == {f"p{k}.txt": f"page {k}" for k in range(40)}
    assert metadata(spark, str(out / "source_md")) == {"a%2Fb.txt": ("1490", 'say "x", y'), "%2E%2E.txt": (None, None)}
    assert metadata(spark, str(out / "target_md")) == {f"p{k}.txt": ("1499", f"t{k}") for k in range(40)}


def test_a_task_that_failed_and_was_repeated(spark, tmp_path):
    """An attempt that broke off leaves no part of the metadata and no half text; the second one's stay."""
    writer = pages.DocFilesWriter(str(tmp_path), ["side", "docid", "text", "year"], False)
    rows = [Row(side="source", docid=f"d{k}", text=f"text {k}", year="1") for k in range(5)]

    def broken():
        yield from rows[:3]
        raise OSError("executor lost")

    try:
        writer.write(broken())
    except OSError:
        pass
    (tmp_path / "source" / ("." + "0" * 32)).write_text("half")
    done = writer.write(iter(rows))
    writer.commit([done, None])
    assert done.documents == {"source": 5}
    assert sorted(os.listdir(tmp_path / "source")) == [f"d{k}.txt" for k in range(5)]
    assert len([n for n in os.listdir(tmp_path / "source_md") if n.startswith("part-")]) == 1
    assert {r.filename for r in tables.read_csv(spark, str(tmp_path / "source_md")).collect()} == {f"d{k}.txt" for k in range(5)}
    writer.abort([done])
    assert os.listdir(tmp_path / "source_md") == []
