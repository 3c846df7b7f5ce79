"""Queries over fetched pages: written from the postings, then read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomline.functions import urls
from loomline.functions.jsontext import json_in_text
from loomline.functions.keys import text
from loomline.plans.network import _CAPS
from loomline.plans.payloads import _sql_plain
from loomline.plans.scalars import SQL as SCALAR, TODAY
from loomline.runtime import read_table, ship
from loomline.sources import pages


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "postings")


def _part(size: int, of: int | None = None) -> Column:
    n = F.floor(F.col("pos") / size)
    return (n if of is None else n % of).cast("int")


def _company(size: int) -> Column:
    return F.concat(F.lit("c"), _part(size).cast("string")).alias("company")


def _joined(rows: DataFrame, by: list[str], piece: Column, sep: str = "") -> DataFrame:
    """One text per page of a bounded number of rows."""
    return rows.withColumn("piece", piece).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), sep).alias("body"))


def s08_list_pages(spark: SparkSession, folder: str) -> DataFrame:
    pos = F.col("pos").cast("string")
    html = F.concat(
        F.lit('<a href="https://c.example/jobs/'), pos, F.lit('/x?mode=1" class="iCIMS_Anchor" title="'), pos, F.lit(' - Role '), pos, F.lit('"><h3 class="t"> '), text("title"), F.lit(' </h3></a><span class="glyphicons-map-marker"></span><dd class="iCIMS_JobHeaderData"><span>'),
        F.regexp_replace(text("place"), r"^([^,]+), ([A-Z]{2})$", "US-$2-$1"), F.lit(' </span></dd><div class="description">'), text("summary"), F.lit("</div>"),
    )
    rows = _rows(spark, folder).withColumns({"company": _company(100), "page_no": _part(25, 4)})
    return pages.list_pages(_joined(rows, ["company", "page_no"], html)).select("company", "title", "place", "url", "summary")


def s06_listed_with_details(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder).withColumns({"company": _company(300), "query_no": _part(60, 5), "page_no": _part(20, 3), "path": F.concat(F.lit("/job/"), F.col("pos").cast("string"))})
    vague = F.col("pos") % 7 == 0
    job = F.to_json(F.struct(F.col("path").alias("externalPath"), text("title").alias("title"), F.when(vague, "3 Locations").otherwise(text("place")).alias("locationsText"), F.lit("Posted Yesterday").alias("postedOn")))
    lists = _joined(rows, ["company", "query_no", "page_no"], job, ",").select("company", F.lit("https://acme.wd5.dayworks.example/en-US/Ext").alias("board_url"), "query_no", "page_no", F.concat(F.lit('{"jobPostings":['), "body", F.lit("]}")).alias("body"))
    info = F.struct(text("place").alias("location"), F.array(F.lit("Hallin")).alias("additionalLocations"), F.lit("2026-04-01").alias("startDate"), text("summary").alias("jobDescription"))
    details = rows.where(vague).select("company", "path", F.to_json(F.struct(info.alias("jobPostingInfo"))).alias("body"))
    return pages.listed_with_details(lists, details, F.lit(TODAY).cast("date")).select("company", "title", "place", "url", "posted", "summary")


def _job_url() -> Column:
    slug = F.coalesce(F.nullif(F.btrim(F.lower(F.regexp_replace(text("title"), "[^A-Za-z]+", "-")), F.lit("-")), F.lit("")), F.lit("role"))
    return F.concat(F.lit("https://acme.jobs/"), F.when(F.col("pos") % 2 == 0, "port-askel-wa/").otherwise(""), slug, F.lit("/"), F.substring(F.md5(F.col("pos").cast("string")), 1, 12), F.lit("/job/"))


def _sitemap(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder).withColumns({"company": _company(200), "child": _part(50, 4)})
    day = F.when(F.col("pos") % 3 == 0, "").otherwise(F.concat(F.lit("<lastmod>"), F.date_sub(F.lit(TODAY).cast("date"), (F.col("pos") % 90).cast("int")).cast("string"), F.lit("T00:00:00Z</lastmod>")))
    block = F.concat(F.lit("<url>\n<loc> "), _job_url(), F.lit(" </loc>"), day, F.lit("</url>"))
    children = _joined(rows, ["company", "child"], block).select("company", F.concat(F.lit("https://acme.jobs/jobs-"), F.col("child").cast("string"), F.lit(".xml")).alias("url"), F.concat(F.lit("<urlset>"), "body", F.lit("</urlset>")).alias("body"))
    listed = "".join(f"<sitemap><loc>https://acme.jobs/{x}.xml</loc></sitemap>" for x in ("pages", "jobs-0", "jobs-1", "jobs-2", "jobs-3"))
    return children.unionByName(rows.select("company").distinct().select("company", F.lit("https://acme.jobs/sitemap.xml").alias("url"), F.lit(f"<sitemapindex>{listed}</sitemapindex>").alias("body")))


def s12_sitemap_entries(spark: SparkSession, folder: str) -> DataFrame:
    return pages.sitemap_entries(_sitemap(spark, folder)).select("company", "url", "changed")


def _job_page() -> Column:
    data = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), text("title").alias("title"), F.lit("2026-04-02").alias("datePosted"), text("summary").alias("description"), F.array(F.struct(F.struct(F.lit("Hallin").alias("addressLocality"), F.lit("NM").alias("addressRegion")).alias("address"))).alias("jobLocation")))
    return F.concat(F.lit('<script type="application/ld+json">{"@type":"Other"}</script><script type="application/ld+json">'), data, F.lit("</script>"))


def s13_sitemap_postings(spark: SparkSession, folder: str) -> DataFrame:
    details = _rows(spark, folder).where("pos % 2 = 1").select(_job_url().alias("url"), _job_page().alias("body"))
    return pages.sitemap_postings(pages.sitemap_entries(_sitemap(spark, folder)), details, F.lit(TODAY).cast("date"), max_age=60).select("company", "title", "place", "url", "posted", "summary")


def s14_structured_posting(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder).select("pos", pages.structured_posting(_job_page()).alias("p"))
    return rows.select("pos", "p.title", "p.place", "p.posted", "p.summary")


def s15_grid_postings(spark: SparkSession, folder: str) -> DataFrame:
    row = F.concat(F.lit("$"), (F.col("pos") % 50).cast("string"), F.lit("' >"))
    cell = lambda field, value: F.concat(F.lit(f"<span id='{field}"), row, value, F.lit("</span>"))
    html = F.concat(cell("SCH_JOB_TITLE", text("title")), cell("LOCATION", text("place")), cell("SCH_OPENED", F.lit("04/02/2026")), F.when(F.col("pos") % 4 > 0, cell("HRS_APP_JBSCH_I_HRS_JOB_OPENING_ID", F.col("pos").cast("string"))).otherwise(""))
    rows = _rows(spark, folder).withColumn("company", _company(50))
    read = pages.grid_postings(_joined(rows, ["company"], html).withColumn("url", F.lit("https://hr.example/psp/ext/x")))
    return read.select("company", "title", "place", "url", "posted")


def e23_careers_links(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    pos = F.col("pos").cast("string")
    body = F.concat(F.lit('<a class="n" href="/about">About</a> <a href="/Careers/'), pos, F.lit('">x</a> <a href="open?p='), pos, F.lit('"><b>Join us</b></a> <a href="/Careers/'), pos, F.lit('">again</a> <a href="mailto:jobs@x.example">m</a>'))
    rows = _rows(spark, folder).select(F.concat(F.lit("https://x.example/d/"), pos).alias("url"), body.alias("body"))
    return pages.careers_links(rows).select("url", F.array_join("links", " ").alias("links"))


def e24_board_behind(spark: SparkSession, folder: str) -> DataFrame:
    pos = F.col("pos").cast("string")
    body = F.concat(F.lit("<a href='https://x.example'>x</a> <a href='https://jobs.lever.co/acme"), pos, F.lit("/jobs/12'>y</a>"))
    return _rows(spark, folder).select("pos", urls.board_behind(F.when(F.col("pos") % 3 == 0, F.concat(F.lit("https://boards.greenhouse.io/"), pos)).otherwise("https://x.example/careers"), F.when(F.col("pos") % 3 == 1, body).otherwise("")).alias("board"))


def e25_json_in_text(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    value = F.to_json(F.struct("pos", F.array(text("source")).alias("s")))
    said = F.when(F.col("pos") % 4 == 0, value).when(F.col("pos") % 4 == 1, F.concat(F.lit("Here [it] is:\n```json\n"), value, F.lit("\n```\nDone."))).when(F.col("pos") % 4 == 2, F.concat(F.lit("I found {this} "), value, F.lit(" and more } of it."))).otherwise("nothing { here")
    return _rows(spark, folder).select("pos", json_in_text(said).alias("json"))


def n07_all_entities(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return _rows(spark, folder).select("pos", pages.unescape_all(F.concat(F.lit("&Eacute;t&#233; &hearts; &amp;lt; "), text("source"))).alias("text"))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name[0] in "nes" and name[1:3].isdigit()}

_DATE = SCALAR["n05_feed_date"].partition("select pos, ")[2].rpartition(" as posted_on")[0]
_SLUG = "coalesce(nullif(trim(lower(regexp_replace(coalesce(title, ''), '[^A-Za-z]+', '-', 'g')), '-'), ''), 'role')"
_URL = f"'https://acme.jobs/' || case when pos % 2 = 0 then 'port-askel-wa/' else '' end || {_SLUG} || '/' || left(md5(cast(pos as varchar)), 12) || '/job/'"
_DAYS = f"case when pos % 3 = 0 then null else date '{TODAY}' - cast(pos % 90 as int) end"
_TITLE = _sql_plain("title")

SQL = {
    "s08_list_pages": rf"""with r as (select *, pos // 100 as c, pos // 25 % 4 as p from postings)
        select 'c' || c as company, trim(regexp_replace(coalesce(nullif({_TITLE}, ''), 'Role ' || pos), '^\d+\s*-\s*', '')) as title, trim(coalesce(place, '')) as place, 'https://c.example/jobs/' || pos || '/x' as url, {_sql_plain('summary')} as summary from r""",
    "s06_listed_with_details": f"""with r as (select *, pos // 300 as c, pos // 60 % 5 as q, pos // 20 % 3 as p from postings), n as (select *, count(*) over (partition by c, q, p) as n from r), s as (select c, q, min(p) as stop from n where n < 20 group by 1, 2),
        k as (select n.* from n left join s using (c, q) where stop is null or p <= stop), a as (select *, pos % 7 = 0 and row_number() over (partition by c, pos % 7 = 0 order by q, p, pos) <= 30 as asked from k)
        select 'c' || c as company, trim(coalesce(title, '')) as title, case when asked then concat_ws('; ', nullif(trim(coalesce(place, '')), ''), 'Hallin') when pos % 7 = 0 then '3 Locations' else trim(coalesce(place, '')) end as place,
        'https://acme.wd5.dayworks.example/Ext/job/' || pos as url, case when asked then date '2026-04-01' else date '{TODAY}' - 1 end as posted, case when asked then {_sql_plain('summary')} else '' end as summary from a""",
    "s12_sitemap_entries": f"select 'c' || pos // 200 as company, {_URL} as url, {_DAYS} as changed from postings",
    "s13_sitemap_postings": f"""with r as (select pos, title, summary, 'c' || pos // 200 as company, {_URL} as url, {_DAYS} as changed, {_SLUG} as slug from postings), k as (select * from r where changed is null or date '{TODAY}' - changed <= 60)
        select company, {_CAPS.format('slug')} as title, 'Port Askel, WA' as place, url, changed as posted, '' as summary from k where pos % 2 = 0
        union all select company, trim(title), 'Hallin, NM', url, date '2026-04-02', {_sql_plain('summary')} from (select * from k where pos % 2 = 1 qualify row_number() over (partition by company order by url) <= 40) where trim(coalesce(title, '')) <> ''""",
    "s14_structured_posting": f"select pos, trim(coalesce(title, '')) as title, 'Hallin, NM' as place, date '2026-04-02' as posted, {_sql_plain('summary')} as summary from postings",
    "s15_grid_postings": """select 'c' || pos // 50 as company, trim(coalesce(title, '')) as title, trim(coalesce(place, '')) as place, date '2026-04-02' as posted, 'https://hr.example/psc/ext/EMPLOYEE/HRMS/c/HRS_HRAM_FL.HRS_CG_SEARCH_FL.GBL?Page=' ||
        case when pos % 4 > 0 then 'HRS_APP_JBPST_FL&Action=U&FOCUS=Applicant&SiteId=1&JobOpeningId=' || pos || '&PostingSeq=1' else 'HRS_APP_SCHJOB_FL&Action=U' end as url from postings""",
    "e23_careers_links": "select 'https://x.example/d/' || pos as url, 'https://x.example/Careers/' || pos || ' https://x.example/d/open?p=' || pos as links from postings",
    "e24_board_behind": "select pos, case pos % 3 when 0 then 'https://boards.greenhouse.io/' || pos when 1 then 'https://jobs.lever.co/acme' || pos else '' end as board from postings",
    "e25_json_in_text": """select pos, case when pos % 4 < 3 then '{"pos":' || pos || ',"s":["' || coalesce(source, '') || '"]}' end as json from postings""",
    "n07_all_entities": "select pos, 'Été ♥ &lt; ' || coalesce(source, '') as text from postings",
}
