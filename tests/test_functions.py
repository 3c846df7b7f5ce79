import datetime as dt

from pyspark.sql import functions as F

from loomline.functions import dates, instants, keys, scores, wording


def _one(spark, make, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make("x").alias("y")).collect()[0].y


def test_keys(spark):
    assert _one(spark, keys.company_key, "Sandia National Laboratories") == _one(spark, keys.company_key, "Sandia Labs") == "sandia"
    assert _one(spark, keys.company_key, None) == ""
    assert _one(spark, keys.title_key, "Senior Data-Engineer II (Remote)") == "data engineer"
    assert _one(spark, keys.url_key, "https://www.Jobs.example/a/b/?utm=1#x") == "jobs.example/a/b"
    assert _one(spark, keys.url_key, "https://x.wd5.dayworks.example/Ext/job/US-Remote/Curator_R-100") == "x.wd5.dayworks.example/Ext/job/R-100"
    assert _one(spark, lambda c: keys.registrable_domain(keys.host_of(c)), "http://a.b.example.co.uk:80/x") == "example.co.uk"
    assert _one(spark, keys.person_key, "https://x/in/Ann-Lee/?a") == "in:ann-lee"
    assert _one(spark, keys.employer_key, " ") == ""


def test_dates(spark):
    for text in ("2026-03-04", "2026/03/04", "3/4/2026", "Mar 4, 2026", "March 4, 2026", "4 Mar 2026", "2026-03-04T10:00"):
        assert _one(spark, dates.written_date, text) == dt.date(2026, 3, 4)
    for text in (None, "", "soon", "2026-13-40", "31 Feb 2026"):
        assert _one(spark, dates.written_date, text) is None
    assert _one(spark, dates.feed_date, "1772582400000") == dt.date(2026, 3, 4)
    today = F.lit("2026-03-31").cast("date")
    assert _one(spark, lambda c: dates.relative_date(c, today), "Posted 30+ Days Ago") == dt.date(2026, 2, 28)
    assert _one(spark, lambda c: dates.relative_date(c, today), "yesterday") == dt.date(2026, 3, 30)
    assert _one(spark, lambda c: dates.relative_date(c, today), "never") is None


def test_mail_instants(spark):
    want = 1756892876
    for text in ("2025-09-03T09:47:56Z", "2025-09-03 09:47:56", "2025-09-03T15:17:56+05:30", "Wed, 03 Sep 2025 15:17:56 +0530", "1756892876000", " 2025-09-03T09:47:56Z "):
        assert _one(spark, lambda c: F.unix_seconds(instants.mail_instant(c)), text) == want
    for text in (None, "", "unknown", "yesterday 14:02", "0000-00-00T00:00:00Z", "2026-13-45T10:00:00Z", "Thu, 00 Jan 0000"):
        assert _one(spark, instants.mail_instant, text) is None


def test_wording(spark):
    assert _one(spark, wording.salary_range, "Pay $150,000 - $180k, 401k matching") == (150000, 180000)
    assert _one(spark, wording.salary_range, "$50 per hour") == (104000, 104000)
    assert _one(spark, wording.salary_range, "about 12 people") is None
    assert _one(spark, wording.work_mode, "Remote, 2 days in office") == "hybrid"
    assert _one(spark, wording.work_mode, None) == "unknown"
    assert _one(spark, wording.title_tokens, "Senior Engineering Manager") == _one(spark, wording.title_tokens, "Engineer, Manager")
    assert _one(spark, wording.needs_clearance, "clearance not required") is False
    assert _one(spark, wording.unwrapped, "a\nb\n\nc") == "a b\n\nc"


def test_scores(spark):
    assert _one(spark, lambda c: scores.recency(F.col(c)), 14, "int") == 50.0
    assert _one(spark, lambda c: scores.recency(F.col(c)), None, "int") == 50.0
    df = scores.with_percentile(spark.createDataFrame([(float(i),) for i in range(9)] + [(None,)], "v double"), "v")
    assert {r.v: r.percentile for r in df.collect()}[4.0] == 50
    assert scores.with_percentile(spark.createDataFrame([(1.0,)], "v double"), "v").collect()[0].percentile is None
