"""Texts reach Python in batches of bounded size."""

from textloom.operators import extract
from textloom.sources.tables import BATCH_BYTES


def test_batches_of_tei_are_bounded(spark):
    """Before, a batch held up to 10,000 documents whatever their length, and all their rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(64 << 20))
    try:
        docs = spark.createDataFrame([("a", "<TEI><text><p>x</p></text></TEI>")], "docid string, xml string")
        extract.extract_tei(docs)
        assert int(spark.conf.get(key)) == BATCH_BYTES
        spark.conf.set(key, "1000")
        extract.extract_tei(docs)
        assert int(spark.conf.get(key)) == 1000
    finally:
        spark.conf.set(key, before)
