"""The table function against the DataFrame functions."""

from __future__ import annotations

from collections import Counter

import pytest

from umbrascan.functions import udtf
from umbrascan.operators import detect
from umbrascan.sources import planted as P

COLUMNS = ["doc_id", "ord", "page", "technique", "text", "reason", "x0", "y0", "x1", "y1", "rule_label", "flag_id"]
SCAN = "SELECT * FROM scan_document(TABLE(spans) PARTITION BY doc_id)"


def flags(spark, spans):
    return detect.label(detect.style_flags(spans, spark.createDataFrame([], "doc_id long, metadata map<string,string>"))).select(*COLUMNS)


def test_same_flags_as_the_dataframe_functions(spark):
    spans = P.spans(P.documents(spark, "/root/testdata/sf0.01"))
    spans.createOrReplaceTempView("spans")
    udtf.register(spark)
    got = spark.sql(SCAN)
    assert got.columns == COLUMNS and dict(got.dtypes)["doc_id"] == "bigint"
    got, want = Counter(map(tuple, got.collect())), Counter(map(tuple, flags(spark, spans).collect()))
    assert got == want and len({t for _, _, _, t, *_ in want}) == 5


def test_odd_spans_and_columns(spark):
    from test_operators import SCHEMA, WHITE, span

    rows = [span("a‍", doc=5), span("b", no=1, doc=5, bg=None, color=0xFFFFFF), span("", no=2, doc=5), span(None, no=3, doc=5), span("x ", line=1, doc=5, alpha=0), span(" y", line=1, no=1, doc=5, alpha=0), span("off", line=2, doc=5, box=(-200, 0, -10, 10), size=0.96), span("Label this", doc=6, size=1.0, bg=WHITE), span("\U000e0068\U000e0069 t", doc=6, line=3)]
    table = spark.createDataFrame(rows, SCHEMA)
    table.filter("text is not null").createOrReplaceTempView("spans")
    udtf.register(spark)
    assert Counter(map(tuple, spark.sql(SCAN).collect())) == Counter(map(tuple, flags(spark, table.filter("text is not null")).collect()))
    table.createOrReplaceTempView("spans")
    assert spark.sql(SCAN).count() > 3
    table.limit(0).createOrReplaceTempView("spans")
    assert spark.sql(SCAN).count() == 0
    table.drop("bg").createOrReplaceTempView("spans")
    with pytest.raises(Exception, match="no columns bg"):
        spark.sql(SCAN).collect()
    with pytest.raises(Exception, match="takes a table"):
        spark.sql("SELECT * FROM scan_document(1)").collect()
