"""Postings and links from fetched pages: HTML lists, grids, sitemaps, structured data.

Every reader takes a table of pages (company, url, body and what it names
further) and is a plan over it; a page that does not parse gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomline.functions import dates, urls
from loomline.functions.keys import host_of, path_of, text
from loomline.functions.markup import plain_text

# How boards write the parts of their pages.
ANCHOR = r'(?i)<a href="([^"]*?/jobs/\d+/[^"]*?)"\s+class="iCIMS_Anchor"\s+title="([^"]*)"'
HEADING = r"(?is)<h3[^>]*>\s*(.*?)\s*</h3>"
PLACE = r'(?is)glyphicons-map-marker.*?<dd class="iCIMS_JobHeaderData">\s*<span[^>]*>\s*([^<]+?)\s*</span>'
DESCRIPTION = r'(?is)<div class="[^"]*description[^"]*">\s*(.*?)</div>'
SITEMAP_URL, SITEMAP_LOC, SITEMAP_DAY = r"(?is)<url>(.*?)</url>", r"(?i)<loc>\s*([^<\s]+)\s*</loc>", r"(?i)<lastmod>\s*([0-9]{4}-[0-9]{2}-[0-9]{2})"
LINKED_DATA = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
PLACE_IN_PATH, NAMELESS = r"(?i)^/([a-z][a-z-]+)-([a-z]{2})/", r"(?i)^(job|jobs|[0-9a-f]{8,}|[0-9a-f-]{30,}|\d+)$"
LINK = r"""(?is)<a\s[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
CAREERS = r"(?i)career|jobs|join[-\s_]?us|work[-\s_]?(with|for|at)[-\s_]?us|vacanc|opportunit|employment|hiring"
GRID_SITE, GRID_COMPONENT = r"/ps[cp]/([A-Za-z0-9_]+)/", "HRS_HRAM_FL.HRS_CG_SEARCH_FL.GBL"
PAGE_ROWS, DETAILS = 20, 30


def list_pages(pages: DataFrame) -> DataFrame:
    """Postings of listing pages (company, page_no, body): each stands between its anchor and the next one.

    The first of an address counts, by page and place on it; what follows a
    page without postings is not read.
    """
    cut = F.split(F.regexp_replace(text("body"), ANCHOR, "\u0001$1\u0002$2\u0003"), "\u0001")
    rows = pages.select("company", "page_no", F.posexplode(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0)))).alias("at", "row"))
    rest = F.substring_index("row", "\u0003", -1)
    named, heading = F.regexp_extract("row", "\u0002([^\u0003]*)\u0003", 1), plain_text(F.regexp_extract(rest, HEADING, 1), 200)
    title = F.trim(F.regexp_replace(F.coalesce(F.nullif(heading, F.lit("")), F.trim(named)), r"^\d+\s*-\s*", ""))
    found = rows.select(
        "company", "page_no", "at", title.alias("title"), urls.listed_place(F.regexp_extract(rest, PLACE, 1)).alias("place"),
        F.substring_index(F.substring_index("row", "\u0002", 1), "?", 1).alias("url"), plain_text(F.regexp_extract(rest, DESCRIPTION, 1)).alias("summary"),
    )
    empty = pages.join(found.select("company", "page_no").distinct(), ["company", "page_no"], "left_anti").groupBy("company").agg(F.min("page_no").alias("stop"))
    read = found.join(empty, "company", "left").where("stop is null or page_no < stop")
    first = read.groupBy("company", "url").agg(F.min_by(F.struct("title", "place", "summary"), F.struct("page_no", "at")).alias("p"))
    return first.select("company", "p.title", "p.place", "url", F.lit("icims").alias("source"), F.lit(None).cast("date").alias("posted"), "p.summary")


def listed_with_details(lists: DataFrame, details: DataFrame, today: Column) -> DataFrame:
    """Postings of searched lists (company, board_url, query_no, page_no, body: JSON) with their detail pages (company, path, body: JSON).

    Each list is a page of twenty of one query; a shorter page is a query's
    last.  The first of an address counts.  Postings that only say how many
    places they have, the first thirty of a board, take places, day and text
    from their detail page, where there is one.
    """
    job = "struct<externalPath:string,title:string,locationsText:string,postedOn:string>"
    parsed = lists.select("company", "board_url", "query_no", "page_no", F.from_json("body", f"jobPostings array<{job}>").alias("j")).withColumn("n", F.coalesce(F.size("j.jobPostings"), F.lit(0)))
    short = parsed.where(F.col("n") < PAGE_ROWS).groupBy("company", "query_no").agg(F.min("page_no").alias("stop"))
    read = parsed.join(short, ["company", "query_no"], "left").where("stop is null or page_no <= stop")
    parts = urls.board_parts("board_url")
    rows = read.select("company", parts["host"].alias("host"), parts["site"].alias("site"), "query_no", "page_no", F.posexplode("j.jobPostings").alias("at", "job")).where("job.externalPath != '' and site != ''")
    at = F.struct("query_no", "page_no", "at")
    first = rows.groupBy("company", F.concat(F.lit("https://"), "host", F.lit("/"), "site", "job.externalPath").alias("url")).agg(F.min(at).alias("order"), F.min_by("job", at).alias("job"))
    vague = F.trim(text("job.locationsText")).rlike(r"(?i)^\d+\s+locations?$")
    # rows of one board that need details are ranked among themselves; the limit is the board's own
    asked = first.where(vague).withColumn("rank", F.row_number().over(Window.partitionBy("company").orderBy("order"))).where(F.col("rank") <= DETAILS).select("company", "url", F.lit(True).alias("asked"))
    info = "jobPostingInfo struct<location:string,additionalLocations:array<string>,startDate:string,externalUrl:string,jobDescription:string>"
    known = details.select("company", F.col("path").alias("externalPath"), F.from_json("body", info)["jobPostingInfo"].alias("d"))
    whole = first.withColumn("externalPath", F.col("job.externalPath")).join(asked, ["company", "url"], "left").join(known, ["company", "externalPath"], "left")
    d = lambda c: F.when(F.col("asked"), F.nullif(F.trim(text(f"d.{c}")), F.lit("")))
    places = F.slice(F.filter(F.transform(F.concat(F.array("d.location"), F.coalesce("d.additionalLocations", F.array().cast("array<string>"))), lambda p: F.trim(text(p))), lambda p: p != ""), 1, 8)
    return whole.select(
        "company", F.trim(text("job.title")).alias("title"), F.coalesce(F.when(F.col("asked") & F.col("d").isNotNull() & (F.size(places) > 0), F.array_join(places, "; ")), F.trim(text("job.locationsText"))).alias("place"),
        F.coalesce(d("externalUrl"), "url").alias("url"), F.lit("workday").alias("source"), F.coalesce(dates.feed_date(d("startDate")), dates.relative_date("job.postedOn", today)).alias("posted"),
        F.when(F.col("asked"), plain_text("d.jobDescription")).otherwise("").alias("summary"),
    )


def sitemap_entries(pages: DataFrame, most: int = 4) -> DataFrame:
    """Addresses of jobs with the day they were last changed, from sitemaps (company, url, body): an index names up to ``most`` further sitemaps."""
    blocks = pages.select("company", "url", F.regexp_extract_all(text("body"), F.lit(SITEMAP_URL), F.lit(1)).alias("blocks"), F.regexp_extract_all(text("body"), F.lit(SITEMAP_LOC), F.lit(1)).alias("locs"))
    index = blocks.where(F.size("blocks") == 0).select("company", F.slice(F.filter("locs", lambda u: ~F.lower(F.substring_index(u, "/", -1)).contains("page")), 1, most).alias("named"))
    children = index.select("company", F.explode("named").alias("url")).distinct()
    indexed = index.where(F.size("named") > 0).select("company").distinct()
    read = blocks.join(children, ["company", "url"], "left_semi").unionByName(blocks.join(indexed, "company", "left_anti"))
    entry = read.select("company", F.explode("blocks").alias("b")).select("company", F.regexp_extract("b", SITEMAP_LOC, 1).alias("url"), F.try_to_date(F.nullif(F.regexp_extract("b", SITEMAP_DAY, 1), F.lit(""))).alias("changed"))
    return entry.where(F.col("url").contains("/job"))


def structured_posting(body: Column | str) -> Column:
    """The first job posting among a page's blocks of linked data: struct of title, place, posted, summary; null for none."""
    address = "struct<addressLocality:string,addressRegion:string>"
    kind = "`@type` string, title string, datePosted string, description string, jobLocation {}"
    many, one = kind.format(f"array<struct<address:{address}>>"), kind.format(f"struct<address:{address}>")

    def read(block: Column) -> Column:
        listed, single = F.from_json(block, many), F.from_json(block, one)
        places = F.coalesce(listed["jobLocation"], F.array(single["jobLocation"]))
        joined = F.transform(places, lambda p: F.concat_ws(", ", F.nullif(F.trim(p["address"]["addressLocality"]), F.lit("")), F.nullif(F.trim(p["address"]["addressRegion"]), F.lit(""))))
        return F.struct(
            F.coalesce(listed["@type"], single["@type"]).alias("kind"), F.trim(text(F.coalesce(listed["title"], single["title"]))).alias("title"), F.array_join(F.array_distinct(F.filter(joined, lambda j: j != "")), "; ").alias("place"),
            dates.feed_date(F.coalesce(listed["datePosted"], single["datePosted"])).alias("posted"), plain_text(F.coalesce(listed["description"], single["description"])).alias("summary"),
        )

    found = F.filter(F.transform(F.regexp_extract_all(text(body), F.lit(LINKED_DATA), F.lit(1)), read), lambda p: p["kind"] == "JobPosting")
    return F.get(found, F.lit(0))


def sitemap_postings(entries: DataFrame, pages: DataFrame, today: Column, max_age: int | None = None, words: tuple[str, ...] = (), most: int = 40) -> DataFrame:
    """Postings of sitemap entries (company, url, changed): place and title from the path, or from the page's linked data.

    Day and title are tested before any page is looked up; of entries whose
    path names no place the first ``most`` of a company by address are looked
    up in ``pages`` (url, body); that limit is the board reader's own.
    """
    path = path_of("url")
    parts = F.filter(F.filter(F.split(path, "/"), lambda p: p != ""), lambda p: ~p.rlike(NAMELESS))
    # the reader's pattern needs the slash that path_of drops at the end
    city, state = F.regexp_extract(F.concat(path, F.lit("/")), PLACE_IN_PATH, 1), F.regexp_extract(F.concat(path, F.lit("/")), PLACE_IN_PATH, 2)
    named = F.when((city != "") & (F.size(parts) > 1), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    rows = entries.select("company", "url", "changed", urls.slug_title(F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit(""))).alias("title"), F.when(city != "", F.concat(urls.slug_title(city), F.lit(", "), F.upper(state))).otherwise("").alias("place")).where("title != ''")
    if max_age is not None:
        rows = rows.where(F.col("changed").isNull() | (F.datediff(today, "changed") <= max_age))
    if words:
        rows = rows.where(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.lower("title").contains(w)))
    ready = rows.where("place != ''").select("company", "title", "place", "url", F.lit(".jobs").alias("source"), F.col("changed").alias("posted"), F.lit("").alias("summary"))
    asked = rows.where("place = ''").withColumn("rank", F.row_number().over(Window.partitionBy("company").orderBy("url"))).where(F.col("rank") <= most)
    told = asked.join(pages.select("url", structured_posting("body").alias("p")), "url").where("p.title != ''")
    return ready.unionByName(told.select("company", "p.title", "p.place", "url", F.lit(".jobs").alias("source"), F.coalesce("p.posted", "changed").alias("posted"), "p.summary"))


def _cells(body: Column, field: str) -> Column:
    """Row number and text of each cell of a grid's field, as a map."""
    pattern = rf"id='{field}\$(\d+)'\s*>([^<]*)<"
    rows, values = F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), F.regexp_extract_all(body, F.lit(pattern), F.lit(2))
    pairs = F.transform(F.arrays_zip(rows.alias("r"), values.alias("v")), lambda x: F.named_struct(F.lit("r"), x["r"].cast("int"), F.lit("v"), x["v"]))
    # of a row number that comes twice the last cell counts
    last = F.aggregate(pairs, F.create_map().cast("map<int,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["r"]), F.create_map(x["r"], x["v"])))
    return last


def grid_postings(pages: DataFrame) -> DataFrame:
    """Postings of result grids (company, url, body) whose cells carry their field and row number."""
    from loomline.functions.markup import unescaped

    body = text("body")
    cells = pages.select("company", "url", *[_cells(body, f).alias(n) for n, f in (("titles", "SCH_JOB_TITLE"), ("ids", "HRS_APP_JBSCH_I_HRS_JOB_OPENING_ID"), ("places", "LOCATION"), ("days", "SCH_OPENED"))])
    rows = cells.select("company", "url", "ids", "places", "days", F.explode("titles").alias("row", "title"))
    at = lambda c: F.trim(unescaped(text(F.try_element_at(c, F.col("row")))))
    site = F.coalesce(F.nullif(F.regexp_extract(path_of("url"), GRID_SITE, 1), F.lit("")), F.lit("applicant"))
    component = F.concat(F.lit("https://"), host_of("url"), F.lit("/psc/"), site, F.lit(f"/EMPLOYEE/HRMS/c/{GRID_COMPONENT}"))
    detail = F.concat(component, F.lit("?Page=HRS_APP_JBPST_FL&Action=U&FOCUS=Applicant&SiteId=1&JobOpeningId="), at("ids"), F.lit("&PostingSeq=1"))
    return rows.select(
        "company", F.trim(unescaped(F.col("title"))).alias("title"), at("places").alias("place"), F.when(at("ids") != "", detail).otherwise(F.concat(component, F.lit("?Page=HRS_APP_SCHJOB_FL&Action=U"))).alias("url"),
        F.lit("peoplesoft").alias("source"), dates.feed_date(at("days")).alias("posted"), F.lit("").alias("summary"),
    )


def careers_links(pages: DataFrame) -> DataFrame:
    """Links of pages (url, body) whose address or label speaks of careers: url, links (absolute, each once, in order).

    Addresses are resolved against the page's own in Arrow batches; no built-in expression does that.
    """
    pairs = F.arrays_zip(F.regexp_extract_all(text("body"), F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all(text("body"), F.lit(LINK), F.lit(2)).alias("label"))
    hits = F.transform(F.filter(pairs, lambda p: p["href"].rlike(CAREERS) | F.regexp_replace(p["label"], "<[^>]+>", " ").rlike(CAREERS)), lambda p: F.trim(p["href"]))

    @F.arrow_udf("array<string>")
    def absolute(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bases, lists in batches:
            out = []
            for base, links in zip(bases.to_pylist(), lists.to_pylist()):
                joined = [_joined(base or "", x) for x in links or []]
                out.append(list(dict.fromkeys(x for x in joined if x.startswith("http"))))
            yield pa.array(out, pa.list_(pa.string()))

    return pages.select("url", absolute(F.col("url"), hits).alias("links"))


def _joined(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return ""


def unescape_all(column: Column) -> Column:
    """A text with all entities that HTML knows resolved, in Arrow batches."""

    @F.arrow_udf("string")
    def resolve(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if x is None else unescape(x) for x in texts.to_pylist()], pa.string())

    return resolve(column)
