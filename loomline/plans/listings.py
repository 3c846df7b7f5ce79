"""Queries over listings, reports and kept tables: orders with caps, statuses, counts, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomline.functions import dates, keys, wording
from loomline.functions.instants import mail_instant
from loomline.operators import mailbox, records
from loomline.plans.relations import _SCORED
from loomline.plans.scalars import SQL as SCALAR, TODAY, sql_company, sql_date
from loomline.runtime import read_table

_today = lambda: F.lit(TODAY).cast("date")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    rows = records.scored(read_table(spark, folder, "postings"), TODAY)
    return rows.withColumn("id", keys.posting_id("url", "company", "title"))


def _applications(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "applications")


def j02_with_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Postings with the best score told for their id; 0 for none."""
    rows = _scored(spark, folder)
    told = rows.where("batch_no = 0 and fit_score is not null").groupBy("id").agg(F.max("fit_score").alias("fit"))
    return rows.select("pos", "id").join(told, "id", "left").select("pos", F.coalesce("fit", F.lit(0)).alias("fit"))


def j03_board_status(spark: SparkSession, folder: str) -> DataFrame:
    """Postings with the status of their id in the history, by default recommended."""
    rows = _scored(spark, folder)
    history = rows.where("batch_no = 0").groupBy("id").agg(F.max_by(F.when(F.col("pos") % 3 == 0, "applied").when(F.col("pos") % 3 == 1, "dismissed").otherwise("dropped"), "pos").alias("status"))
    return rows.select("pos", "id").join(history, "id", "left").select("pos", F.coalesce("status", F.lit("recommended")).alias("status"))


def f13_seen_before(spark: SparkSession, folder: str) -> DataFrame:
    """Later postings and whether the history knows them as applied or dismissed, by id, else address, else company and title."""
    rows = read_table(spark, folder, "postings").select("pos", "batch_no", keys.posting_id("url", "company", "title").alias("id"), keys.url_key("url").alias("u"), keys.company_key("company").alias("c"), keys.title_key("title").alias("t"))
    status = F.when(F.col("pos") % 3 == 0, "applied").when(F.col("pos") % 3 == 1, "dismissed").otherwise("dropped")
    old = rows.where("batch_no = 0").withColumn("status", status)
    latest = lambda by, name, where: old.where(where).groupBy(*by).agg(F.max_by("status", "pos").alias(name))
    new = rows.where("batch_no > 0").join(latest(["id"], "s_id", "true"), "id", "left").join(latest(["u"], "s_u", "u != ''"), "u", "left").join(latest(["c", "t"], "s_p", "c != '' and t != ''"), ["c", "t"], "left")
    return new.select("pos", F.coalesce("s_id", "s_u", "s_p", F.lit("")).isin("applied", "dismissed").alias("seen"))


def f20_since(spark: SparkSession, folder: str) -> DataFrame:
    """Mail written since a day; undated mail stays."""
    at = mail_instant("msg_date")
    return read_table(spark, folder, "messages").where(at.isNull() | (F.to_date(at) >= F.lit("2026-01-01").cast("date"))).select("row_no")


def f22_covers(spark: SparkSession, folder: str) -> DataFrame:
    """Whether an application's span, ninety days wider on each side, holds the day; one without any date holds nothing."""
    rows = _applications(spark, folder).select("application_id", dates.written_date("applied").alias("s"), dates.written_date("last_heard").alias("e"))
    day = F.lit("2026-01-15").cast("date")
    held = (F.col("s").isNull() | (F.date_sub("s", 90) <= day)) & (F.col("e").isNull() | (F.date_add("e", 90) >= day))
    return rows.select("application_id", (held & (F.col("s").isNotNull() | F.col("e").isNotNull())).alias("covers"))


def a14_usage_share(spark: SparkSession, folder: str) -> DataFrame:
    """Units by source, in all, and the share of each in hundredths."""
    per = read_table(spark, folder, "postings").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("fit_score", F.lit(0))).alias("units"))
    total = per.agg(F.sum("units")).scalar()
    return per.select("source", "n", "units", F.bround(100.0 * F.col("units") / total, 2).alias("share"))


def a15_buckets_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """Postings by source class in the fixed order of classes."""
    from loomline.functions import urls

    order = F.array(*[F.lit(x) for x in ("ats", "employer", "public", "unknown", "denied")])
    kind = urls.source_class("url", "company")["class"]
    return read_table(spark, folder, "postings").groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n")).select(F.array_position(order, F.col("class")).cast("int").alias("place"), "class", "n").orderBy("place")


def a17_recent_days(spark: SparkSession, folder: str) -> DataFrame:
    """Mail and characters of each of the last sixty days that have any."""
    per = read_table(spark, folder, "messages").groupBy(F.to_date("received_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("body", F.lit("")))).alias("chars"))
    return per.where(F.col("day") > F.date_sub(per.agg(F.max("day")).scalar(), 60))


def a20_by_status(spark: SparkSession, folder: str) -> DataFrame:
    return _applications(spark, folder).where("status = 'interviewed'").select("application_id")


def a21_board_counts(spark: SparkSession, folder: str) -> DataFrame:
    s = F.lower(keys.text("status"))
    return _applications(spark, folder).agg(F.count(F.lit(1)).alias("roles"), F.count_if(s == "rejected").alias("rejected"), F.count_if(s == "interviewed").alias("interviewed"), F.count_distinct(F.nullif(keys.company_key("company"), F.lit(""))).alias("employers"))


def l03_applied_first(spark: SparkSession, folder: str) -> DataFrame:
    """Sixty employers to look up, those applied to first; the limit is the feature."""
    names = read_table(spark, folder, "postings").select(keys.company_key("company").alias("name"), F.lit(0).alias("a")).unionAll(_applications(spark, folder).select(keys.company_key("company"), F.lit(1))).where("name != ''")
    return names.groupBy("name").agg(F.max("a").alias("applied")).orderBy(F.desc("applied"), "name").limit(60)


def l05_capped(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty best postings to verify, the others deferred; the cap is a top-k, no rank over all rows."""
    rows = _scored(spark, folder).select("pos", "composite")
    best = rows.orderBy(F.desc("composite"), "pos").limit(20).withColumn("part", F.lit("verify"))
    return best.select("pos", "part").unionByName(rows.join(best.select("pos"), "pos", "left_anti").select("pos", F.lit("deferred").alias("part")))


def l09_coverage_order(spark: SparkSession, folder: str) -> DataFrame:
    """Employers of contacts, most contacts first, then by name."""
    rows = read_table(spark, folder, "contacts").select(keys.company_key("company").alias("name")).where("name != ''")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name")


def l11_profile_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty-four documents that tell most of a person, cut to 6,000 characters; both limits are the feature."""
    rank = F.coalesce(F.array_position(F.array(F.lit("resume"), F.lit("cover_letter"), F.lit("job_description"), F.lit("correspondence")), F.coalesce("kind", F.lit(""))), F.lit(0))
    rows = read_table(spark, folder, "documents").where("text is not null and text != ''").select("doc_id", F.when(rank == 0, 9).otherwise(rank).alias("rank"), F.length("text").alias("n"), F.left("text", F.lit(6000)).alias("text"))
    return rows.orderBy("rank", F.desc("n"), "doc_id").limit(24).select("doc_id", F.length("text").alias("n"))


def l13_history_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Forty applications, last heard of first; the limit is the feature."""
    rows = _applications(spark, folder).select("application_id", F.coalesce(F.nullif("last_heard", F.lit("")), "applied", F.lit("")).alias("at"))
    return rows.orderBy(F.desc("at"), "application_id").limit(40)


def n48_as_list(spark: SparkSession, folder: str) -> DataFrame:
    """A text, or a JSON list of texts, as a list without blanks."""
    said = F.when(F.col("pos") % 2 == 0, F.to_json(F.array(keys.text("source"), F.lit(""), keys.text("place")))).otherwise(keys.text("source"))
    as_list = F.when(said.startswith("["), F.from_json(said, "array<string>")).otherwise(F.array(said))
    return read_table(spark, folder, "postings").select("pos", F.array_join(F.filter(F.transform(as_list, F.trim), lambda x: x != ""), "|").alias("items"))


def n50_profile_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens of all roles applied for, each once."""
    return _applications(spark, folder).select(F.explode(wording.title_tokens("job_role")).alias("token")).distinct()


def n51_last_activity(spark: SparkSession, folder: str) -> DataFrame:
    return _applications(spark, folder).select("application_id", F.greatest(keys.text("applied"), keys.text("last_heard")).alias("last"))


def n52_two_way(spark: SparkSession, folder: str) -> DataFrame:
    return mailbox.mail_conversations(read_table(spark, folder, "messages")).select("address", ((F.col("sent") > 0) & (F.col("received") > 0)).alias("two_way"))


def u01_baseline_and_pool(spark: SparkSession, folder: str) -> DataFrame:
    """The bag of composites of history and pool, equal ones as often as they stand there."""
    rows = _scored(spark, folder)
    history = rows.where("batch_no = 0 and composite > 0").join(rows.where("batch_no > 0").select("id"), "id", "left_anti").select("composite")
    return history.unionAll(rows.where("batch_no > 0").select("composite"))


def u02_baseline_less_current(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scored(spark, folder)
    return rows.where("batch_no = 0").join(rows.where("batch_no > 0").select("id").distinct(), "id", "left_anti").select("pos")


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name[0] in "nfjalu" and name[1:3].isdigit()}

_C, _D = sql_company("company"), sql_date
_ID = SCALAR["n10_posting_id"].partition("select pos, ")[2].rpartition(" as id")[0]
_U = SCALAR["n03_canonical_url"].partition("select pos, ")[2].rpartition(" as url_key")[0]
_T = SCALAR["n02_normalize_title"].partition("select pos, ")[2].rpartition(" as title_key")[0]
_STATUS = "case pos % 3 when 0 then 'applied' when 1 then 'dismissed' else 'dropped' end"


def _sql() -> dict[str, str]:
    from loomline.plans.mailbox import _CONVERSATIONS, _DAY, _READ
    from loomline.plans.network import SQL as NETWORK

    rows = f"r as (select *, {_ID} as id from {_SCORED})"
    tokens = SCALAR["n22_title_tokens"].replace("title", "job_role").replace("select pos, array_to_string(", "select unnest(").replace(", ' ') as tokens from postings", ") as token from applications")
    return {
        "j02_with_scores": f"with {rows} select pos, coalesce(fit, 0) as fit from r left join (select id, max(fit_score) as fit from r where batch_no = 0 group by 1) using (id)",
        "j03_board_status": f"with {rows} select pos, coalesce(status, 'recommended') as status from r left join (select id, arg_max({_STATUS}, pos) as status from r where batch_no = 0 group by 1) using (id)",
        "f13_seen_before": f"""with p as (select pos, batch_no, {_ID} as id, {_U} as u, {_C} as c, {_T} as t from postings), o as (select *, {_STATUS} as s from p where batch_no = 0)
            select pos, coalesce(a.s, b.s, d.s, '') in ('applied', 'dismissed') as seen from p left join (select id, arg_max(s, pos) as s from o group by 1) a using (id) left join (select u, arg_max(s, pos) as s from o where u <> '' group by 1) b using (u)
            left join (select c, t, arg_max(s, pos) as s from o where c <> '' and t <> '' group by 1, 2) d using (c, t) where batch_no > 0""",
        "f20_since": f"select row_no from (select row_no, {_DAY} as ts from (select row_no, trim(msg_date) as d from messages)) where ts is null or cast(ts as date) >= date '2026-01-01'",
        "f22_covers": f"select application_id, (s is null or s - 90 <= date '2026-01-15') and (e is null or e + 90 >= date '2026-01-15') and (s is not null or e is not null) as covers from (select application_id, {_D('applied')} as s, {_D('last_heard')} as e from applications)",
        "a14_usage_share": "select source, n, units, round_even(100e0 * units / sum(units) over (), 2) as share from (select coalesce(source, 'none') as source, count(*) as n, cast(sum(coalesce(fit_score, 0)) as bigint) as units from postings group by 1)",
        "a15_buckets_in_order": f"select cast(list_position(['ats', 'employer', 'public', 'unknown', 'denied'], class) as int) as place, class, count(*) as n from ({NETWORK['e16_source_class']}) group by class",
        "a17_recent_days": "select day, n, chars from (select cast(received_at as date) as day, count(*) as n, cast(sum(length(coalesce(body, ''))) as bigint) as chars, max(cast(received_at as date)) as d, max(max(cast(received_at as date))) over () as last from messages group by 1) where day > last - 60",
        "a20_by_status": "select application_id from applications where status = 'interviewed'",
        "a21_board_counts": f"select count(*) as roles, count(*) filter (lower(status) = 'rejected') as rejected, count(*) filter (lower(status) = 'interviewed') as interviewed, count(distinct nullif({_C}, '')) as employers from applications",
        "l03_applied_first": f"select name, cast(max(a) as int) as applied from (select {_C} as name, 0 as a from postings union all select {_C}, 1 from applications) where name <> '' group by 1 order by applied desc, name limit 60",
        "l05_capped": f"select pos, case when row_number() over (order by composite desc, pos) <= 20 then 'verify' else 'deferred' end as part from {_SCORED}",
        "l09_coverage_order": f"select {_C} as name, count(*) as n from contacts where {_C} <> '' group by 1 order by n desc, name",
        "l11_profile_documents": "select doc_id, cast(least(length(text), 6000) as int) as n from documents where text <> '' order by coalesce(list_position(['resume', 'cover_letter', 'job_description', 'correspondence'], kind), 9), length(text) desc, doc_id limit 24",
        "l13_history_listing": "select application_id, coalesce(nullif(last_heard, ''), applied, '') as \"at\" from applications order by \"at\" desc, application_id limit 40",
        "n48_as_list": "select pos, case when pos % 2 = 0 then concat_ws('|', nullif(trim(coalesce(source, '')), ''), nullif(trim(coalesce(place, '')), '')) else trim(coalesce(source, '')) end as items from postings",
        "n50_profile_tokens": f"select distinct token from ({tokens})",
        "n51_last_activity": "select application_id, greatest(coalesce(applied, ''), coalesce(last_heard, '')) as last from applications",
        "n52_two_way": f"with {_READ}, {_CONVERSATIONS} select address, sent > 0 and received > 0 as two_way from g",
        "u01_baseline_and_pool": f"with {rows} select composite from r where batch_no = 0 and composite > 0 and id not in (select id from r where batch_no > 0) union all select composite from r where batch_no > 0",
        "u02_baseline_less_current": f"with {rows} select pos from r where batch_no = 0 and id not in (select id from r where batch_no > 0)",
    }


SQL = _sql()
