"""Postings of job boards from their JSON payloads, one declaration per kind of board."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomline.functions.dates import feed_date
from loomline.functions.markup import plain_text


def _s(name: str) -> Column:
    return F.trim(F.coalesce(F.col(f"job.{name}").cast("string"), F.lit("")))


def _first(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def _joined(sep: str, *columns: Column) -> Column:
    return F.concat_ws(sep, *[F.nullif(c, F.lit("")) for c in columns])


def _remote(place: Column, flag: Column) -> Column:
    """A place that says it is remote, if the flag does and the place does not yet."""
    say = F.coalesce(flag, F.lit(False)) & ~F.lower(place).contains("remote")
    return F.when(say & (place != ""), F.concat(F.lit("Remote — "), place)).when(say, "Remote").otherwise(place)


@dataclass(frozen=True)
class Board:
    """How a kind of board writes jobs: schema of one job, field that holds the list ("" for the payload itself), columns."""

    job: str
    field: str
    columns: Callable[[], dict[str, Column]]
    listed: Callable[[], Column] = lambda: F.lit(True)


def _lever_place() -> Column:
    place, kind = _s("categories.location"), F.lower(_s("workplaceType"))
    return F.when((kind != "") & ~F.lower(place).contains(kind), F.trim(F.concat(place, F.lit(" ("), kind, F.lit(")")))).otherwise(place)


def _ashby_place() -> Column:
    place = _s("location")
    more = F.filter(F.transform(F.coalesce(F.col("job.secondaryLocations.location"), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: (x != "") & (F.lower(x) != F.lower(place)))
    return _remote(F.when(F.size(more) > 0, F.concat(place, F.lit("; also "), F.array_join(F.slice(more, 1, 6), ", "))).otherwise(place), F.col("job.isRemote"))


def _ultipro_place() -> Column:
    places = F.filter(F.transform(F.coalesce(F.col("job.Locations.LocalizedDescription"), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return _remote(F.array_join(F.slice(places, 1, 6), "; "), F.lower(_s("JobLocationType")) == "remote")


BOARDS: dict[str, Board] = {
    "greenhouse": Board(
        "title string, location struct<name:string>, absolute_url string, first_published string, updated_at string, content string", "jobs",
        lambda: {"title": _s("title"), "place": _s("location.name"), "url": _s("absolute_url"), "posted": _first(_s("first_published"), _s("updated_at")), "text": F.col("job.content"), "salary": F.lit("")},
    ),
    "lever": Board(
        "text string, categories struct<location:string>, workplaceType string, hostedUrl string, applyUrl string, createdAt string, descriptionPlain string, description string", "",
        lambda: {"title": _s("text"), "place": _lever_place(), "url": _first(_s("hostedUrl"), _s("applyUrl")), "posted": _s("createdAt"), "text": _first(_s("descriptionPlain"), _s("description")), "salary": F.lit("")},
    ),
    "ashby": Board(
        "title string, location string, secondaryLocations array<struct<location:string>>, isRemote boolean, isListed boolean, jobUrl string, applyUrl string, publishedAt string, descriptionPlain string, descriptionHtml string", "jobs",
        lambda: {"title": _s("title"), "place": _ashby_place(), "url": _first(_s("jobUrl"), _s("applyUrl")), "posted": _s("publishedAt"), "text": _first(_s("descriptionPlain"), _s("descriptionHtml")), "salary": F.lit("")},
        lambda: F.coalesce(F.col("job.isListed"), F.lit(True)),
    ),
    "smartrecruiters": Board(
        "id string, name string, location struct<fullLocation:string,city:string,region:string,country:string,remote:boolean>, releasedDate string", "content",
        lambda: {"title": _s("name"), "place": _remote(_first(_s("location.fullLocation"), _joined(" ", _s("location.city"), _s("location.region"), _s("location.country"))), F.col("job.location.remote")), "url": F.when(_s("id") != "", F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("slug"), F.lit("/"), _s("id"))).otherwise(""), "posted": _s("releasedDate"), "text": F.lit(""), "salary": F.lit("")},
    ),
    "workable": Board(
        "title string, location struct<city:string,region:string,country:string>, telecommuting boolean, url string, application_url string, published_on string, created_at string, description string", "jobs",
        lambda: {"title": _s("title"), "place": _remote(_joined(", ", _s("location.city"), _s("location.region"), _s("location.country")), F.col("job.telecommuting")), "url": _first(_s("url"), _s("application_url")), "posted": _first(_s("published_on"), _s("created_at")), "text": F.col("job.description"), "salary": F.lit("")},
    ),
    "breezy": Board(
        "name string, location struct<city:string,state:struct<id:string>,country:struct<name:string>,is_remote:boolean>, url string, published_date string, salary string", "",
        lambda: {"title": _s("name"), "place": _remote(_joined(", ", _s("location.city"), _s("location.state.id"), _s("location.country.name")), F.col("job.location.is_remote")), "url": _s("url"), "posted": _s("published_date"), "text": F.lit(""), "salary": _s("salary")},
    ),
    "rippling": Board(
        "name string, workLocation struct<label:string,id:string>, url string", "",
        lambda: {"title": _s("name"), "place": _first(_s("workLocation.label"), _s("workLocation.id")), "url": _s("url"), "posted": F.lit(""), "text": F.lit(""), "salary": F.lit("")},
    ),
    "ultipro": Board(
        "Id string, Title string, Locations array<struct<LocalizedDescription:string>>, JobLocationType string, PostedDate string, BriefDescription string", "opportunities",
        lambda: {"title": _s("Title"), "place": _ultipro_place(), "url": F.concat(F.regexp_replace(F.col("url"), "/+$", ""), F.lit("/OpportunityDetail?opportunityId="), _s("Id")), "posted": _s("PostedDate"), "text": F.col("job.BriefDescription"), "salary": F.lit("")},
    ),
}


def board_postings(payloads: DataFrame, kind: str) -> DataFrame:
    """Postings of the payloads (company, url, body) of one kind of board.

    Columns: company, title, place, url, source, posted (date), salary,
    summary.  A body that is null or no JSON has no postings, unknown fields
    are ignored and missing ones empty; nothing is shuffled.
    """
    board = BOARDS[kind]
    shape = f"struct<{board.field}:array<struct<{_compact(board.job)}>>>" if board.field else f"array<struct<{_compact(board.job)}>>"
    parsed = F.from_json("body", shape)
    jobs = F.col(f"ll_parsed.{board.field}") if board.field else F.col("ll_parsed")
    slug = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-z]+://)?[^/]+/+([^/?#]+)", 1)
    rows = payloads.select("company", "url", slug.alias("slug"), parsed.alias("ll_parsed")).select("company", "url", "slug", F.explode(jobs).alias("job")).where("job is not null")
    c = board.columns()
    return rows.where(board.listed()).select("company", c["title"].alias("title"), c["place"].alias("place"), c["url"].alias("url"), F.lit(kind).alias("source"), feed_date(c["posted"]).alias("posted"), c["salary"].alias("salary"), plain_text(c["text"]).alias("summary"))


def _compact(fields: str) -> str:
    """``a string, b int`` as ``a:string,b:int``, nested types left alone."""
    out, depth, part = [], 0, ""
    for ch in fields + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += ch
    return ",".join(out)


def kind_of(url: Column | str) -> Column:
    """The kind of board that an address belongs to, or null."""
    low = F.lower(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")))
    hosts = {"greenhouse": "greenhouse.io", "lever": "lever.co", "ashby": "ashbyhq.com", "smartrecruiters": "smartrecruiters.com", "workable": "workable.com", "breezy": "breezy.hr", "rippling": "rippling.com", "ultipro": "ultipro.com"}
    out = F.lit(None).cast("string")
    for kind, host in reversed(hosts.items()):
        out = F.when(low.rlike(rf"^(?:[a-z]+://)?(?:[^/]*\.)?{host.replace('.', chr(92) + '.')}(?:[:/?#]|$)"), kind).otherwise(out)
    return out
