"""Rules that are tried where they can hold give what the plain pattern gives; records of an audit are made once."""

import os
import time

from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import numbers as N
from tidemark.operators import extract as X
from tidemark.sources import sinks as SK

CELL = "<tr><td>Interest expense</td><td>3</td><td>(4)</td></tr>"


def test_a_tag_is_read_once():
    html = "<p>Before</p><table>" + CELL * 200 + "</table>"
    X._TAGS.clear()
    table = X._plain(html)[0]
    assert set(X._TAGS) >= {"td", "/td", "tr"} and table["context"] == "Before" and len(table["rows"]) == 200
    # a tag with attributes of its own is not kept
    X._plain("<td title='" + "x" * 500 + "'>")
    assert all(len(text) <= X.TAG_CHARS for text in X._TAGS)
    assert X._plain("<table><tr><td colspan=2>x") is None and X._plain("a < b") is None
    script = "<script>if (a<b) t='<table>';</script>after<style>x<y</style><!-- <td> -->end<table><tr><th>1"
    assert [(t["context"], t["rows"][0][0]["text"]) for t in X._plain(script)] == [("after end", ["1"])]


def test_many_plain_pages_take_a_fraction_of_the_parser():
    page = "<h2>Statements (USD in thousands)</h2><table>" + CELL * 30 + "</table>"

    def spent(run):
        best = 1e9
        for _ in range(5):
            started = time.process_time()
            for _ in range(30):
                run()
            best = min(best, time.process_time() - started)
        return best

    def library():
        parser = X._Tables()
        parser.feed(page)
        parser.close()
        return parser.tables

    strip = lambda tables: [{k: v for k, v in t.items() if k != "in"} for t in tables]
    assert strip(X._plain(page)) == strip(library())
    assert 3 * spent(lambda: X._plain(page)) < spent(library)


def test_numbers_and_dates_as_before(spark):
    texts = ["1,234", "$ (1,234.5)", "(12", "12)", "-", "—", "N/A", "$", "", "5%", " 7 ", "1\t000", "(-3)", "1e3", ".5", "12a", "()", "((4))", None]
    expected = [1234.0, -1234.5, None, None, None, None, None, None, None, 5.0, 7.0, 1000.0, None, 1000.0, 0.5, None, None, None, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [r[0] for r in rows.orderBy("i").select(N.parse_cell_number(F.col("text"))).collect()] == expected
    labels = ["Year ended March 31, 2025", "31 march 2025, then April 30, 2024", "on 5 May 2021", "February 30, 2024", "2024", "", None]
    dates = ["2025-03-31", "2024-04-30", "2021-05-05", None, None, None, None]
    rows = spark.createDataFrame(list(enumerate(labels)), "i int, text string")
    assert [r[0] and str(r[0]) for r in rows.orderBy("i").select(D.parse_date_header(F.col("text"))).collect()] == dates


def test_audit_records_are_computed_once(spark, tmp_path):
    spent = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            spent.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(f"T{i}", "revenue", "1998A", float(i), "OK") for i in range(20)], "ticker string, metric string, period string, value double, status string")
    SK.write_audit(rows.mapInArrow(count, rows.schema), str(tmp_path / "audit"))
    assert spent.value == 20
    assert {r["ticker"] for r in SK.read_audit(spark, str(tmp_path / "audit")).collect()} == {f"T{i}" for i in range(20)}
    assert os.path.isdir(tmp_path / "audit" / "manifest")
