"""Queries over board payloads (written from the postings, then read back) and upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomline.functions import keys
from loomline.functions.markup import ENTITIES, plain_text
from loomline.operators import records, upserts
from loomline.plans.relations import _SCORED
from loomline.plans.scalars import SQL as SCALAR, TODAY, sql_company, sql_host
from loomline.runtime import read_table
from loomline.sources.boards import board_postings, kind_of

_c = F.col
_JOBS: dict[str, tuple[str, Callable[[], list[Column]]]] = {
    "greenhouse": ("jobs", lambda: [_c("title"), F.struct(_c("place").alias("name")).alias("location"), _c("url").alias("absolute_url"), _c("posted").alias("updated_at"), _c("summary").alias("content")]),
    "lever": ("", lambda: [_c("title").alias("text"), F.struct(_c("place").alias("location")).alias("categories"), F.lit("remote").alias("workplaceType"), _c("url").alias("applyUrl"), _c("posted").alias("createdAt"), _c("summary").alias("description")]),
    "ashby": ("jobs", lambda: [_c("title"), _c("place").alias("location"), F.array(F.struct(F.lit("Hallin").alias("location"))).alias("secondaryLocations"), (_c("pos") % 2 == 0).alias("isRemote"), (_c("pos") % 5 != 0).alias("isListed"), _c("url").alias("jobUrl"), _c("posted").alias("publishedAt"), _c("summary").alias("descriptionPlain")]),
    "smartrecruiters": ("content", lambda: [_c("pos").cast("string").alias("id"), _c("title").alias("name"), F.struct(_c("place").alias("city"), F.lit("").alias("region"), F.lit("QX").alias("country")).alias("location"), _c("posted").alias("releasedDate")]),
    "workable": ("jobs", lambda: [_c("title"), F.struct(_c("place").alias("city"), F.lit("QX").alias("country")).alias("location"), (_c("pos") % 2 == 0).alias("telecommuting"), _c("url"), _c("posted").alias("created_at"), _c("summary").alias("description")]),
    "breezy": ("", lambda: [_c("title").alias("name"), F.struct(_c("place").alias("city"), F.struct(F.lit("NM").alias("id")).alias("state")).alias("location"), _c("url"), _c("posted").alias("published_date"), _c("salary")]),
    "rippling": ("", lambda: [_c("title").alias("name"), F.struct(_c("place").alias("label")).alias("workLocation"), _c("url")]),
    "ultipro": ("opportunities", lambda: [_c("pos").cast("string").alias("Id"), _c("title").alias("Title"), F.array(F.struct(_c("place").alias("LocalizedDescription")), F.struct(F.lit("Kelda").alias("LocalizedDescription"))).alias("Locations"), F.lit("Remote").alias("JobLocationType"), _c("posted").alias("PostedDate"), _c("summary").alias("BriefDescription")]),
}
_NUMBERS = {"greenhouse": "s01", "lever": "s02", "ashby": "s03", "smartrecruiters": "s04", "workable": "s05", "breezy": "s09", "rippling": "s10", "ultipro": "s11"}


def _board(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        field, fields = _JOBS[kind]
        job = F.array(F.struct(*fields()))
        body = F.to_json(F.struct(job.alias(field))) if field else F.to_json(job)
        payloads = read_table(spark, folder, "postings").select("company", F.lit("https://boards.example/acme/jobs").alias("url"), body.alias("body"))
        return board_postings(payloads, kind)

    return query


def n07_plain_text(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", plain_text("text").alias("text"))


def s17_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    host = F.replace(F.replace(F.lower(keys.text("url")), F.lit("boards.greenstem.example"), F.lit("boards.greenhouse.io")), F.lit("jobs.levra.example"), F.lit("jobs.lever.co"))
    return read_table(spark, folder, "postings").select("pos", kind_of(host).alias("kind"))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = records.scored(read_table(spark, folder, "postings"), TODAY)
    return rows.select("batch_no", keys.posting_id("url", "company", "title").alias("id"), F.when(F.col("pos") % 3 == 0, "applied").when(F.col("pos") % 3 == 1, "dropped").otherwise("recommended").alias("status"), F.col("pos").cast("string").alias("reason"), "composite", F.when(F.col("pos") % 2 == 0, "scored").otherwise("found").alias("stage"), F.coalesce("title", F.lit("")).alias("title"))


def k01_history_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    empty = spark.createDataFrame([], "id string, status string, reason string, composite double, first_seen string, last_seen string, note string")
    start = upserts.record_history(empty, rows.where("batch_no = 0"), "2026-01-01")
    return upserts.record_history(start, rows.where("batch_no > 0"), TODAY)


def k04_board_merge(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    empty = spark.createDataFrame([], "id string, stage string, title string, composite double, first_seen string, last_scored string")
    return upserts.merge_board(upserts.merge_board(empty, rows.where("batch_no = 0"), "2026-01-01"), rows.where("batch_no > 0"), TODAY)


QUERIES = {f"{n}_{kind}": _board(kind) for kind, n in _NUMBERS.items()} | {f.__name__: f for f in (n07_plain_text, s17_dispatch, k01_history_upsert, k04_board_merge)}


def _sql_plain(x: str) -> str:
    def unescape(y: str) -> str:
        for entity, sign in ENTITIES.items():
            y = f"replace({y}, '{entity}', '{sign.replace(chr(39), chr(39) * 2)}')"
        return y

    bare = unescape(f"regexp_replace({unescape(f"coalesce({x}, '')")}, '<[^>]*>', ' ', 'g')")
    return rf"rtrim(left(trim(regexp_replace({bare}, '\s+', ' ', 'g')), 600))"


def _sql_board(kind: str, place: str, url: str = "trim(coalesce(url, ''))", posted: bool = True, summary: bool = True, salary: str = "''", where: str = "true") -> str:
    date = SCALAR["n05_feed_date"].partition("select pos, ")[2].rpartition(" as posted_on")[0]
    return f"""select company, trim(coalesce(title, '')) as title, {place} as place, {url} as url, '{kind}' as source, {date if posted else "cast(null as date)"} as posted, {salary} as salary, {_sql_plain('summary') if summary else "''"} as summary
        from (select *, trim(coalesce(place, '')) as p from postings) where {where}"""


_REMOTE = "case when {0} and not contains(lower({1}), 'remote') then case when {1} = '' then 'Remote' else 'Remote — ' || {1} end else {1} end"
_ASHBY = "(case when lower(p) <> 'hallin' then p || '; also Hallin' else p end)"
_ID = SCALAR["n10_posting_id"].partition("select pos, ")[2].rpartition(" as id")[0]
_ROWS = f"(select batch_no, {_ID} as id, case pos % 3 when 0 then 'applied' when 1 then 'dropped' else 'recommended' end as status, cast(pos as varchar) as reason, composite, case when pos % 2 = 0 then 'scored' else 'found' end as stage, coalesce(title, '') as title from {_SCORED})"

SQL = {
    "s01_greenhouse": _sql_board("greenhouse", "p"),
    "s02_lever": _sql_board("lever", "case when contains(lower(p), 'remote') then p else trim(p || ' (remote)') end"),
    "s03_ashby": _sql_board("ashby", _REMOTE.format("pos % 2 = 0", _ASHBY), where="pos % 5 <> 0"),
    "s04_smartrecruiters": _sql_board("smartrecruiters", "concat_ws(' ', nullif(p, ''), 'QX')", "'https://jobs.smartrecruiters.com/acme/' || pos", summary=False),
    "s05_workable": _sql_board("workable", _REMOTE.format("pos % 2 = 0", "concat_ws(', ', nullif(p, ''), 'QX')")),
    "s09_breezy": _sql_board("breezy", "concat_ws(', ', nullif(p, ''), 'NM')", summary=False, salary="trim(coalesce(salary, ''))"),
    "s10_rippling": _sql_board("rippling", "p", posted=False, summary=False),
    "s11_ultipro": _sql_board("ultipro", _REMOTE.format("true", "concat_ws('; ', nullif(p, ''), 'Kelda')"), "'https://boards.example/acme/jobs/OpportunityDetail?opportunityId=' || pos"),
    "n07_plain_text": f"select doc_id, {_sql_plain('text')} as text from documents",
    "s17_dispatch": "select pos, case when " + sql_host("url") + " = 'boards.greenstem.example' then 'greenhouse' when " + sql_host("url") + " = 'jobs.levra.example' then 'lever' end as kind from postings",
    "k01_history_upsert": f"""with b as (select id, max(row(composite, status, reason)) as n from {_ROWS} where batch_no = 0 group by id), a as (select id, max(row(composite, status, reason)) as n from {_ROWS} where batch_no > 0 group by id)
        select coalesce(a.id, b.id) as id, case when a.id is null or b.n[2] in ('applied', 'dismissed') then b.n[2] else a.n[2] end as status, case when a.id is null or b.n[2] in ('applied', 'dismissed') then b.n[3] else a.n[3] end as reason,
        coalesce(a.n[1], b.n[1]) as composite, case when b.id is null then '{TODAY}' else '2026-01-01' end as first_seen, case when a.id is null then '2026-01-01' else '{TODAY}' end as last_seen, '' as note from b full join a on a.id = b.id""",
    "k04_board_merge": f"""with r as (select *, case stage when 'scored' then 3 else 1 end as k from {_ROWS}), b as (select id, max(row(k, composite, stage, title)) as n from r where batch_no = 0 group by id), a as (select id, max(row(k, composite, stage, title)) as n from r where batch_no > 0 group by id)
        select coalesce(a.id, b.id) as id, case when a.id is null or a.n[1] < b.n[1] then b.n[3] else a.n[3] end as stage, case when a.id is null then b.n[4] when a.n[1] < b.n[1] then coalesce(nullif(a.n[4], ''), b.n[4]) else a.n[4] end as title,
        case when a.id is null then b.n[2] when a.n[1] < b.n[1] then coalesce(nullif(a.n[2], 0), b.n[2]) else a.n[2] end as composite, case when b.id is null then '{TODAY}' else '2026-01-01' end as first_seen, case when a.id is null then '2026-01-01' else '{TODAY}' end as last_scored from b full join a on a.id = b.id""",
}
