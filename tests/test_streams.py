import datetime

from pyspark.sql import functions as F

from tidemark.streaming import jobs as J

DAY = datetime.datetime(2024, 3, 5)
FILES = [
    [("A", 1.0, DAY), ("A", 3.0, DAY + datetime.timedelta(hours=5)), ("B", 2.0, DAY)],
    [("A", 9.0, DAY + datetime.timedelta(days=1)), ("B", 4.0, DAY + datetime.timedelta(hours=1)), ("C", 5.0, DAY)],
    [("D", 7.0, DAY - datetime.timedelta(days=2)), ("A", 0.5, DAY - datetime.timedelta(days=2)), ("A", 8.0, DAY + datetime.timedelta(hours=2)), ("B", 6.0, DAY)],
]


def _stream(spark, folder):
    """The three files, one per micro-batch, the last with the oldest events."""
    schema = "ticker string, price double, fetched_at timestamp"
    for i, rows in enumerate(FILES):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def _all():
    return [row for rows in FILES for row in rows]


def _state(spark, folder, run, *args):
    run(_stream(spark, folder), f"{folder}/out", *args)
    return J.latest_version(spark, f"{folder}/out/state")


def test_latest_quote_of_files_in_any_order(spark, tmp_path):
    got = {r.ticker: r.price for r in _state(spark, str(tmp_path), J.stream_latest_quote).collect()}
    assert got == {t: max((at, p) for x, p, at in _all() if x == t)[1] for t in "ABCD"}


def test_history_keeps_late_days_and_the_newest_price(spark, tmp_path):
    got = {(r.ticker, str(r.day)): r.price for r in _state(spark, str(tmp_path), J.stream_price_history).collect()}
    keys = {(t, str(at.date())) for t, _, at in _all()}
    assert got == {(t, d): max((at, p) for x, p, at in _all() if x == t and str(at.date()) == d)[1] for t, d in keys}


def test_bars_count_every_event(spark, tmp_path):
    state = J.bars(_state(spark, str(tmp_path), J.stream_bars))
    got = {(r.ticker, str(r.d)): (r.open, r.high, r.low, r.close, r.n) for r in state.withColumn("d", F.to_date("start")).collect()}
    expected = {}
    for t, d in {(t, str(at.date())) for t, _, at in _all()}:
        own = sorted((at, p) for x, p, at in _all() if x == t and str(at.date()) == d)
        prices = [p for _, p in own]
        expected[t, d] = (prices[0], max(prices), min(prices), prices[-1], len(prices))
    assert got == expected
