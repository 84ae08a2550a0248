"""The price files: whole lines are extracted without bringing cells together again."""

import datetime as dt

from pyspark.sql import functions as F

from verdant.operators import ingest as A
from verdant.plans import catalog
from verdant.plans import queries_text as Q

MAPPING = [(0, "symbol"), (1, "date"), (3, "close"), (3, "again"), (-1, "never"), (9, "never2")]
CHUNKS = [("a", "[CSV, Rows 2-3]\n x\t2020-01-01\tjunk\t 1.5 \n\n[note]\n y,2020-01-02\nz\t\t\t"), ("b", "one"), ("c", ""), ("d", None)]


def _long_as_records(chunks, mapping, **kw):
    long = A.extract_tabular(chunks, mapping, **kw)
    return long.groupBy("chunk_id", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("record"))


def _rows(df):
    return sorted((r.chunk_id, r.line_no, sorted(r.record.items())) for r in df.collect())


def test_records_are_the_long_form_by_line(spark):
    mapping = spark.createDataFrame(MAPPING, "col_idx int, field string")
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, text string")
    want = _rows(_long_as_records(chunks, mapping))
    assert _rows(A.extract_tabular(chunks, mapping, long=False)) == want and len(want) == 4
    assert want[0] == ("a", 1, [("again", "1.5"), ("close", "1.5"), ("date", "2020-01-01"), ("symbol", "x")])
    nothing = spark.createDataFrame([(5, "close")], "col_idx int, field string")
    assert A.extract_tabular(chunks, nothing, long=False).count() == 0


def test_records_by_source(spark):
    mapping = spark.createDataFrame([("p", 0, "symbol"), ("q", 1, "symbol"), ("q", 0, "date")], "source string, col_idx int, field string")
    chunks = spark.createDataFrame([("a", "p", "u,v"), ("b", "q", "u,v"), ("c", "r", "u,v"), ("d", None, "u,v")], "chunk_id string, source string, text string")
    want = _rows(_long_as_records(chunks, mapping, source="source"))
    assert _rows(A.extract_tabular(chunks, mapping, source="source", long=False)) == want and len(want) == 2


class _Prices:
    def __init__(self, df):
        self.df, self.spark = df, df.sparkSession

    def prices(self):
        return self.df


def _prices(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(250)]
    rows = [(s, d, 1.5, 3.0, 2.25 + i, i) for s in ("S1", "S2", None) for i, d in enumerate(days[:250 if s == "S1" else 1])]
    return spark.createDataFrame(rows, "symbol string, date date, low double, high double, close double, volume bigint")


def test_a_file_begins_with_its_header(spark):
    files = Q._price_files(_Prices(_prices(spark)))
    for name, n in (("S1", 250), ("S2", 1), (None, 1)):
        rows = files.where(F.col("file_id").eqNullSafe(F.lit(name))).orderBy("row_no").collect()
        assert [r.row_no for r in rows] == list(range(n + 1)) and rows[0].cells == Q._PRICE_FIELDS
    plan = files._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Window") == 1      # the prices are worked out once


def test_lines_are_not_brought_together_again(spark, monkeypatch):
    asked = []
    extract = A.extract_tabular
    monkeypatch.setattr(A, "extract_tabular", lambda *a, **k: asked.append(k.get("long", True)) or extract(*a, **k))
    monkeypatch.setattr(catalog, "Tables", lambda spark, sf_dir: _Prices(_prices(spark)))
    out = Q.a8_a13_price_file_roundtrip(spark, "")
    assert asked == [False]
    got = {(r.symbol, r.date): (r.low, r.high, r.close, r.volume) for r in out.collect()}
    assert len(got) == 251 and got["S1", dt.date(2020, 1, 6)] == (1.5, 3.0, 7.25, 5)


def test_a_file_that_is_only_a_header_and_one_without_a_name(spark):
    rows = [("a", 0, ["h", "k"]), ("b", 0, ["h"]), ("b", 1, ["1"]), (None, 0, ["h"]), (None, 1, ["2"])]
    df = spark.createDataFrame(rows, "file_id string, row_no bigint, cells array<string>")
    got = {(r.file_id, r.page_no): r.page_text for r in A.rows_to_pages(df).collect()}
    assert got == {("a", 0): "h\tk", ("b", 0): "[CSV, Rows 2-2]\nh\n1", (None, 0): "h"}
    sheet = df.withColumn("sheet", F.lit("s"))
    assert {r.file_id: r.page_text for r in A.rows_to_pages(sheet, kind="sheet", sheet="sheet").collect()} == {
        "a": "[Sheet: s]\nh\tk", "b": "[Sheet: s]\nh\n1", None: "[Sheet: s]\nh\n2"}
