"""Queries over gates, joins, folds, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomline.functions import dates, keys, scores, wording
from loomline.operators import records
from loomline.plans.scalars import TODAY, sql_company, sql_date, sql_title, sql_url
from loomline.runtime import read_table

_today = lambda: F.lit(TODAY).cast("date")
_SCORED = f"""(select *, cast(round_even(r, 0) as int) as recency, floor((0.45e0 * coalesce(fit_score, 0) + 0.30e0 * coalesce(likelihood, 0)) / 0.75e0 * (0.75e0 + 0.25e0 * r / 100e0) * 100e0 + 0.5e0) / 100e0 as composite from (
    select *, case when age_days is null then 50e0 else 100e0 * pow(0.5e0, greatest(age_days, 0) / 14e0) end as r from (select *, date '{TODAY}' - {sql_date('posted')} as age_days from postings)))"""


def f02_freshness(spark: SparkSession, folder: str) -> DataFrame:
    ok, why = records.freshness(dates.written_date("posted"), _today(), 60)
    return read_table(spark, folder, "postings").select("pos", ok.alias("ok"), why.alias("reason"))


def f05_excluded_company(spark: SparkSession, folder: str) -> DataFrame:
    low = F.lower(keys.text("company"))
    return read_table(spark, folder, "postings").select("pos", (low.contains("logistics") | (keys.company_key("company") == keys.company_key(F.lit("Copperlane Payments Inc")))).alias("excluded"))


def f06_salary_gate(spark: SparkSession, folder: str) -> DataFrame:
    pay = wording.salary_range(F.concat_ws(" ", keys.text("salary"), keys.text("summary")))
    rows = read_table(spark, folder, "postings").select("pos", pay.alias("pay"))
    state = records.pay_state(F.col("pay.low"), F.col("pay.high"), 90_000, 250_000)
    return rows.select("pos", F.when(state.isNull(), "unknown").when(state, "pass").otherwise("fail").alias("state"), records.gate(state, "include").alias("ok"))


def f09_title_gate(spark: SparkSession, folder: str) -> DataFrame:
    state = records.title_state(F.col("title"), ["intern", "manager"], ["engineer", "scientist", "developer"])
    return read_table(spark, folder, "postings").select("pos", F.when(state.isNull(), "unknown").when(state, "pass").otherwise("fail").alias("state"))


def f16_narrow_board(spark: SparkSession, folder: str) -> DataFrame:
    wanted = ["data", "software", "engineer", "developer", "analyst"]
    rows = read_table(spark, folder, "postings").select("pos", keys.company_key("company").alias("company_key"), wording.title_relevance("title", wanted).alias("relevance")).where("relevance > 0")
    # a small board is kept whole by the same limit
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("company_key").orderBy(F.desc("relevance"), "pos")))
    return ranked.where("r <= 25").select("pos", "company_key", F.round("relevance", 4).alias("relevance"))


def f19_within_years(spark: SparkSession, folder: str) -> DataFrame:
    seen = dates.written_date("seen")
    return read_table(spark, folder, "contacts").where(seen.isNull() | (seen >= F.date_sub(_today(), int(365.25 * 1.5)))).select("contact_id")


def j04_contacts_targets(spark: SparkSession, folder: str) -> DataFrame:
    people = read_table(spark, folder, "contacts").select("contact_id", keys.company_key("company").alias("company_key"))
    targets = read_table(spark, folder, "applications").select(keys.company_key("company").alias("company_key")).where("company_key != ''").groupBy("company_key").agg(F.count(F.lit(1)).alias("n_applications"))
    return people.join(targets, "company_key", "left").select("contact_id", F.coalesce("n_applications", F.lit(0)).alias("n_applications"))


def j09_coverage(spark: SparkSession, folder: str) -> DataFrame:
    targets = read_table(spark, folder, "applications").select(keys.company_key("company").alias("company_key")).where("company_key != ''").distinct()
    people = read_table(spark, folder, "contacts").select(keys.company_key("company").alias("company_key"), "contact_id").groupBy("company_key").agg(F.count("contact_id").alias("n"))
    return targets.join(people, "company_key", "left").select("company_key", F.coalesce("n", F.lit(0)).alias("n_contacts"))


def j14_canonical_name(spark: SparkSession, folder: str) -> DataFrame:
    entered = read_table(spark, folder, "aliases").select(keys.company_key("spelling").alias("k"), "canonical").dropDuplicates(["k"])
    rows = read_table(spark, folder, "postings").select("pos", "company", keys.company_key("company").alias("k"))
    return rows.join(entered, "k", "left").select("pos", F.coalesce("canonical", "company").alias("company"))


def j15_applied_flags(spark: SparkSession, folder: str) -> DataFrame:
    applied = read_table(spark, folder, "applications").where("thread_id is not null").select(F.trim("thread_id").alias("thread_id")).distinct()
    threads = read_table(spark, folder, "messages").where("thread_id is not null").select(F.trim("thread_id").alias("thread_id")).distinct()
    return threads.join(applied, "thread_id", "left_semi")


def j18_unseen(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "postings").select("pos", "batch_no", keys.posting_id("url", "company", "title").alias("id"))
    return rows.where("batch_no > 0").join(rows.where("batch_no = 0").select("id"), "id", "left_anti").select("pos")


def a01_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "postings").select("pos", keys.posting_id("url", "company", "title").alias("id"), keys.company_key("company").alias("company_key"), keys.title_key("title").alias("title_key"))
    return records.deduplicated(rows, "id", ["company_key", "title_key"], "pos").select("pos")


def a10_thread_dates(spark: SparkSession, folder: str) -> DataFrame:
    return records.thread_dates(read_table(spark, folder, "messages"))


def a12_drop_counters(spark: SparkSession, folder: str) -> DataFrame:
    ok, _ = records.freshness(dates.written_date("posted"), _today(), 60)
    bucket = F.when(keys.text("company") == "", "no company").when(dates.written_date("posted").isNull(), "undated").when(~ok, "stale").otherwise("kept")
    return read_table(spark, folder, "postings").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def a13_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "applications").groupBy(F.lower(F.trim(F.coalesce("status", F.lit("")))).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def a14_usage_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "postings").select(F.coalesce("source", F.lit("none")).alias("source"), "batch_no")
    return rows.rollup("source", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def a16_corpus_summary(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").groupBy("company").agg(F.count(F.lit(1)).alias("n_docs"), F.max("modified").alias("last_touched"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def a22_import_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "contacts").select(keys.company_key("company").alias("k"), dates.written_date("seen").alias("d"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.nullif("k", F.lit(""))).alias("employers"), F.count_if(F.col("d").isNotNull()).alias("dated"))


def w02_composite(spark: SparkSession, folder: str) -> DataFrame:
    return records.scored(read_table(spark, folder, "postings"), TODAY).select("pos", "recency", "composite")


def w04_percentile(spark: SparkSession, folder: str) -> DataFrame:
    rows = scores.with_percentile(records.scored(read_table(spark, folder, "postings"), TODAY), "composite")
    return rows.select("pos", "percentile", scores.band(F.col("percentile"), F.col("composite")).alias("band"))


def w06_best_per_company(spark: SparkSession, folder: str) -> DataFrame:
    rows = records.scored(read_table(spark, folder, "postings"), TODAY).withColumn("company_key", F.coalesce(F.nullif(keys.company_key("company"), F.lit("")), F.lower(keys.text("company"))))
    return records.best_per_key(rows, "company_key", [F.desc("composite"), F.asc("pos")], 2).select("pos", "company_key", "composite", "also")


def w12_days_quiet(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "applications")
    return rows.select("application_id", F.datediff(_today(), F.coalesce(dates.written_date("last_heard"), dates.written_date("applied"))).alias("days_quiet"))


def l01_top_postings(spark: SparkSession, folder: str) -> DataFrame:
    """A report of the forty best; the limit is the feature."""
    return records.scored(read_table(spark, folder, "postings"), TODAY).orderBy(F.desc("composite"), F.lower("company"), "pos").limit(40).select("pos", "composite")


def u01_all_companies(spark: SparkSession, folder: str) -> DataFrame:
    tables = [read_table(spark, folder, t).select(keys.company_key("company").alias("company_key")) for t in ("postings", "applications", "contacts")]
    return tables[0].union(tables[1]).union(tables[2]).where("company_key != ''").distinct()


def u02_companies_without_contact(spark: SparkSession, folder: str) -> DataFrame:
    a, b = (read_table(spark, folder, t).select(keys.company_key("company").alias("company_key")) for t in ("postings", "contacts"))
    return a.where("company_key != ''").subtract(b)


def u03_board_union(spark: SparkSession, folder: str) -> DataFrame:
    """What goes to the board: postings recommended and those put off, which the cap per employer holds back, together."""
    rows = records.scored(read_table(spark, folder, "postings"), TODAY).withColumn("company_key", keys.company_key("company"))
    rank = F.row_number().over(Window.partitionBy("company_key").orderBy(F.desc("composite"), "pos"))
    ranked = rows.withColumn("r", rank)
    recommended = ranked.where("r <= 1").select("pos", "composite", F.lit("recommended").alias("part"))
    return recommended.unionByName(ranked.where("r > 1").select("pos", "composite", F.lit("deferred").alias("part")))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name[0] in "fjawlu" and name[1:3].isdigit()}

_C, _D = sql_company("company"), sql_date
_ID = f"left(sha1(case when {sql_url('url')} <> '' then {sql_url('url')} else {_C} || '|' || {sql_title('title')} end), 12)"
_AGE = f"(date '{TODAY}' - {_D('posted')})"
_TRI = "case when {0} is null then 'unknown' when {0} then 'pass' else 'fail' end"


def _sql() -> dict[str, str]:
    from loomline.plans.scalars import SQL as scalar

    return {
        "f02_freshness": f"""select pos, coalesce(a <= 60, false) as ok, case when a is null then 'no date' when a < 0 then 'posted today' when a > 60 then 'posted ' || a || ' days ago (limit 60)' else 'posted ' || a || ' day(s) ago' end as reason
            from (select pos, {_AGE} as a from postings)""",
        "f05_excluded_company": f"select pos, contains(lower(coalesce(company, '')), 'logistics') or {_C} = 'copperlane payments' as excluded from postings",
        "f06_salary_gate": f"""select pos, {_TRI.format('s')} as state, coalesce(s, true) as ok from (select pos, case when low is null then null else high >= 90000 and low <= 250000 end as s from ({scalar['e01_salary']}))""",
        "f09_title_gate": f"""select pos, {_TRI.format('s')} as state from (select pos, case when trim(t) = '' then null else not (contains(t, 'intern') or contains(t, 'manager')) and (contains(t, 'engineer') or contains(t, 'scientist') or contains(t, 'developer')) end as s
            from (select pos, lower(coalesce(title, '')) as t from postings))""",
        "f16_narrow_board": f"""select pos, company_key, relevance from (select pos, company_key, relevance, count(*) over (partition by company_key) as n, row_number() over (partition by company_key order by relevance desc, pos) as r
            from (select pos, {_C} as company_key from postings) join ({scalar['e26_title_relevance']}) using (pos) where relevance > 0) where n <= 8 or r <= 25""",
        "f19_within_years": f"select contact_id from contacts where {_D('seen')} is null or {_D('seen')} >= date '{TODAY}' - 547",
        "j04_contacts_targets": f"""select contact_id, coalesce(n, 0) as n_applications from (select contact_id, {_C} as k from contacts) left join (select {_C} as k, count(*) as n from applications where {_C} <> '' group by 1) using (k)""",
        "j09_coverage": f"""select k as company_key, count(contact_id) as n_contacts from (select distinct {_C} as k from applications where {_C} <> '') left join (select {_C} as k, contact_id from contacts) using (k) group by k""",
        "j14_canonical_name": f"select pos, coalesce(canonical, company) as company from (select pos, company, {_C} as k from postings) left join (select {sql_company('spelling')} as k, min(canonical) as canonical from aliases group by 1) using (k)",
        "j15_applied_flags": "select distinct trim(thread_id) as thread_id from messages where trim(thread_id) in (select trim(thread_id) from applications where thread_id is not null)",
        "j18_unseen": f"with p as (select pos, batch_no, {_ID} as id from postings) select pos from p where batch_no > 0 and id not in (select id from p where batch_no = 0)",
        "a10_thread_dates": """with m as (select thread_id, received_at, row_no, coalesce(from_me, false) as me, row_number() over (partition by thread_id order by received_at, row_no) as r from messages where thread_id is not null),
            t as (select thread_id, max(r) filter (not me) as theirs from m group by 1)
            select thread_id, min(received_at) as first_at, max(received_at) as last_at, arg_max(me, r) as last_mine, bool_or(me) as replied, cast(count(*) filter (me and r > coalesce(theirs, 0)) as int) as chased from m join t using (thread_id) group by 1""",
        "a12_drop_counters": f"select case when coalesce(company, '') = '' then 'no company' when {_D('posted')} is null then 'undated' when {_AGE} > 60 then 'stale' else 'kept' end as bucket, count(*) as n from postings group by 1",
        "a13_status_counts": "select lower(trim(coalesce(status, ''))) as status, count(*) as n from applications group by 1",
        "a14_usage_rollup": "select source, batch_no, count(*) as n, grouping_id(source, batch_no) as level from (select coalesce(source, 'none') as source, batch_no from postings) group by rollup (source, batch_no)",
        "a16_corpus_summary": "select company, count(*) as n_docs, max(modified) as last_touched, coalesce(array_to_string(list_sort(list_distinct(list(kind) filter (kind is not null))), ','), '') as kinds from documents group by 1",
        "a22_import_counts": f"select count(*) as n, count(distinct nullif({_C}, '')) as employers, count({_D('seen')}) as dated from contacts",
        "w02_composite": f"select pos, recency, composite from {_SCORED}",
        "w04_percentile": f"""select pos, percentile, case when percentile >= 90 then 'top 10% of everything seen' when percentile >= 75 then 'top quarter' when percentile >= 50 then 'above your median' else 'below your median' end as band from (
            select pos, cast(round_even(100.0 * (rank() over (order by composite) - 1 + 0.5 * count(*) over (partition by composite)) / count(*) over (), 0) as int) as percentile from {_SCORED})""",
        "w06_best_per_company": f"""select pos, company_key, composite, cast(case when r = 1 then greatest(0, n - 2) else 0 end as int) as also from (select pos, k as company_key, composite, row_number() over (partition by k order by composite desc, pos) as r, count(*) over (partition by k) as n
            from (select *, case when {_C} = '' then lower(coalesce(company, '')) else {_C} end as k from {_SCORED})) where r <= 2""",
        "w12_days_quiet": f"select application_id, cast(date '{TODAY}' - coalesce({_D('last_heard')}, {_D('applied')}) as int) as days_quiet from applications",
        "l01_top_postings": f"select pos, composite from {_SCORED} order by composite desc, lower(company), pos limit 40",
        "u01_all_companies": f"select distinct company_key from (select {_C} as company_key from postings union all select {_C} from applications union all select {_C} from contacts) where company_key <> ''",
        "u02_companies_without_contact": f"select {_C} as company_key from postings where {_C} <> '' except select {_C} from contacts",
        "u03_board_union": f"select pos, composite, case when row_number() over (partition by k order by composite desc, pos) = 1 then 'recommended' else 'deferred' end as part from (select *, {_C} as k from {_SCORED})",
    }


SQL = _sql()
