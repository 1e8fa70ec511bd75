from datetime import date

from tidemark.operators import extract as X

HTML = """<p>Reconciliation to Adjusted EBITDA, non-GAAP (USD in thousands)</p><table>
<tr><th></th><th colspan="2">Three months ended</th></tr><tr><th></th><th>March 31, 2024</th><th>March 31, 2023</th></tr>
<tr><td rowspan="2">Net income</td><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr>
<tr><td>Depreciation</td><td>1</td><td>1</td></tr><tr><td>Interest</td><td>1</td><td>1</td></tr>
<tr><td>Adjusted EBITDA</td><td>$1,500</td><td>(20)</td></tr></table>"""


def docs(spark):
    return spark.createDataFrame([(1, HTML)], "doc_id bigint, html string")


def test_spans_fill_the_grid(spark):
    grid = {(r.row, r.col): r.text for r in X.explode_tables(docs(spark)).collect()}
    assert grid[(0, 1)] == grid[(0, 2)] == "Three months ended"
    assert grid[(2, 0)] == grid[(3, 0)] == "Net income"
    assert grid[(3, 1)] == "3"


def test_reconciliation_facts(spark):
    d = docs(spark)
    filings = spark.createDataFrame([(1, 12, 31)], "doc_id bigint, fye_month int, fye_day int")
    facts, rejected = X.recon_facts(X.explode_tables(d), X.table_contexts(d), filings)
    got = sorted((r.start_date, r.end_date, r.value, r.currency) for r in facts.collect())
    assert got == [(date(2023, 1, 1), date(2023, 3, 31), -20000.0, "USD"), (date(2024, 1, 1), date(2024, 3, 31), 1500000.0, "USD")]
    assert rejected.count() == 0


def test_inline_facts_follow_their_context(spark):
    html = ('<xbrli:context id="c"><xbrli:startDate>2023-01-01</xbrli:startDate><xbrli:endDate>2023-03-31</xbrli:endDate></xbrli:context>'
            '<xbrli:unit id="u"><xbrli:measure>iso4217:EUR</xbrli:measure></xbrli:unit>'
            '<ix:nonFraction name="us-gaap:Revenues" contextRef="c" unitRef="u" scale="6" sign="-">1.5</ix:nonFraction>')
    out = X.inline_facts(spark.createDataFrame([(1, html)], "doc_id bigint, html string")).first()
    assert (out.value, out.currency, out.end_date) == (-1500000.0, "EUR", date(2023, 3, 31))


def test_readable_text_keeps_long_lines(spark):
    html = "<html><title>A &amp; B</title><div></div><nav>" + "n" * 50 + "</nav><p>" + "word " * 10 + "</p><p>short</p></html>"
    out = X.readable_text(spark.createDataFrame([(html,)], "html string")).first()
    assert (out.title, out.text) == ("A & B", ("word " * 10).strip())


def test_plain_reader_agrees_with_the_library_parser():
    odd = ["", "<table><tr><td>a<td>b</table>", "<TABLE><TR><TH COLSPAN='2'>a &amp; b</TH></TR></TABLE>", "<script>var x = '<table>';</script><table><td/>", "<table><td>1 < 2</td></table>",
           "<!-- <table> --><table><caption>c</caption><tr><td colspan=\"&#50;\">x</table>", "<title><table></title>", "<table><td a=b>x</td></table>", "<style>td</style><table><td>5</td", HTML]
    read = 0
    for html in odd:
        parser = X._Tables()
        parser.feed(html)
        parser.close()
        assert X._parse(html) == parser.tables
        read += X._plain(html) is not None
    assert read == 6


def test_pages_of_a_small_file_are_dealt_out(spark, tmp_path):
    from tidemark.catalog.q_documents import pages
    from tidemark.catalog.views import Views

    rows = [(i, i, "1-URGENT") for i in range(64)]
    orders = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderpriority string").selectExpr("*", "timestamp '1996-05-05' AS o_orderdate")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    sizes = pages(Views(spark, str(tmp_path))).rdd.glom().map(len).collect()
    assert sum(sizes) == 64 and max(sizes) <= 16
