import datetime as dt

from loomline.streaming import counters


def _run(spark, df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_bucket_waits():
    waits, tokens, _ = counters.bucket_waits([0.0] * 6 + [0.5, 10.0], 5.0, None, 2.0, 5.0)
    assert waits == [0, 0, 0, 0, 0, 0.5, 0, 0] and tokens == 4


def test_ledger_steps():
    steps, spent = counters.ledger_steps([("reserve", 6), ("reserve", 6), ("settle", -4), ("reserve", 6), ("settle", -99)], 0.0, 10)
    assert [g for g, _ in steps] == [True, False, True, True, True] and spent == 0
    assert counters.ledger_steps([("reserve", 99)], 0.0, 0)[0][0][0]


def test_token_buckets_over_a_stream(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    spark.createDataFrame([("a", at + dt.timedelta(milliseconds=i)) for i in range(7)] + [("b", at)], "domain string, at timestamp").write.parquet(str(tmp_path / "in"))
    calls = spark.readStream.schema("domain string, at timestamp").parquet(str(tmp_path / "in"))
    rows = _run(spark, counters.token_buckets(calls), "waits")
    assert sum(r.wait_s == 0 for r in rows if r.domain == "a") == 5 and [r.wait_s for r in rows if r.domain == "b"] == [0]


def test_spend_ledger_over_a_stream(spark, tmp_path):
    shape = "day string, seq bigint, kind string, amount double"
    spark.createDataFrame([("d", 1, "reserve", 6.0), ("d", 2, "reserve", 6.0), ("e", 1, "reserve", 6.0)], shape).write.parquet(str(tmp_path / "in"))
    rows = _run(spark, counters.spend_ledger(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), 10.0), "spent")
    assert {(r.day, r.seq): r.granted for r in rows} == {("d", 1): True, ("d", 2): False, ("e", 1): True}
