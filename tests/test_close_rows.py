"""The snapshot panel is made once for all scans of the close's audit."""

from tidemark import catalog


def test_close_semantics_reads_written_rows(spark):
    found = catalog.queries()["a19_close_semantics"](spark, "/root/testdata/sf0.001")
    assert found.inputFiles() and not any("events" in f for f in found.inputFiles())
    assert found.agg({"row_count": "sum"}).first()[0] > 0
