"""Exports: contact lists with a preamble, mail archives, JSON and JSON-lines tables."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomline.functions.keys import profile_slug
from loomline.runtime import ship

# Names under which exports give a field.
CONTACT_COLUMNS = {
    "first_name": ("first name",), "last_name": ("last name",), "url": ("url", "profile url"), "email": ("email address", "email"),
    "company": ("company", "current company"), "position": ("position", "current position", "title"), "connected_on": ("connected on", "connected"),
}


def contact_rows(text: str, search: int = 20) -> Iterator[tuple[str, ...]]:
    """Contacts of one export; its header is looked for in the first ``search`` rows, rows without name and address are left out."""
    places: dict[str, int] = {}
    for number, row in enumerate(csv.reader(io.StringIO(text.lstrip("﻿")))):
        if not places:
            cells = {c.strip().lower().lstrip("﻿"): i for i, c in enumerate(row)}
            seen = {field: next(cells[n] for n in names if n in cells) for field, names in CONTACT_COLUMNS.items() if any(n in cells for n in names)}
            if "first_name" in seen or {"company", "position"} <= set(seen):
                places = seen
            elif number + 1 >= search:
                break
            continue
        values = tuple(row[places[f]].strip() if f in places and places[f] < len(row) else "" for f in CONTACT_COLUMNS)
        if values[0] or values[1] or values[2]:
            yield values
    if not places:
        raise ValueError("no header of contacts found: a row that names First Name, or Company and Position")


def read_contacts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Contacts of all export files under a path, CSV files and those in zip archives, with the file they come from.

    A file without a header is an error that names it; with ``strict`` off it
    has no rows.
    """
    ship(spark)

    def texts(at: str, content: bytes) -> Iterator[tuple[str, str]]:
        if not at.lower().endswith(".zip"):
            yield at, content.decode("utf-8", "replace")
            return
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for name in archive.namelist():
                if name.rpartition("/")[2].lower().startswith("connections") and name.lower().endswith(".csv"):
                    yield f"{at}!{name}", archive.read(name).decode("utf-8", "replace")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, content in zip(frame["path"], frame["content"]):
                for at, text in texts(p, bytes(content)):
                    try:
                        rows += [(at, *r) for r in contact_rows(text)]
                    except ValueError as e:
                        if strict:
                            raise ValueError(f"{at}: {e}") from None
            yield pd.DataFrame(rows, columns=["path", *CONTACT_COLUMNS])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, " + ", ".join(f"{c} string" for c in CONTACT_COLUMNS))


def month_start(c: Column) -> Column:
    """``Jun 2024``, ``June 2024`` or ``2024`` as the first day of it, in text; anything else as it is."""
    t = F.trim(F.coalesce(c, F.lit("")))
    day = F.coalesce(*[F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(form)).cast("date")) for shape, form in ((r"^[A-Za-z]{3} \d{4}$", "MMM yyyy"), (r"^[A-Za-z]{4,9} \d{4}$", "MMMM yyyy"), (r"^\d{4}$", "yyyy"))])
    return F.coalesce(day.cast("string"), t)


def read_spells(spark: SparkSession, positions: str | None, education: str | None) -> DataFrame:
    """Spells of work and schooling of an export's two files (kind, name, start, end); rows without a name are left out."""
    parts = []
    for path, kind, name, start, end in ((positions, "employer", "Company Name", "Started On", "Finished On"), (education, "school", "School Name", "Start Date", "End Date")):
        if path:
            rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
            parts.append(rows.select(F.lit(kind).alias("kind"), F.trim(F.coalesce(F.col(f"`{name}`"), F.lit(""))).alias("name"), month_start(F.col(f"`{start}`")).alias("start"), month_start(F.col(f"`{end}`")).alias("end")).where("name != ''"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_conversations(spark: SparkSession, path: str, me: str) -> DataFrame:
    """Conversations of an export's messages (FROM, TO, DATE and profile addresses) with each profile: key, name, sent, received, last_sent, last_received."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    t = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    out = t("FROM") == me
    url = F.split(F.when(out, t("RECIPIENT PROFILE URLS")).otherwise(t("SENDER PROFILE URL")), ",")[0]
    told = rows.select(profile_slug(url).alias("key"), F.when(out, t("TO")).otherwise(t("FROM")).alias("name"), out.alias("out"), F.left(t("DATE"), F.lit(10)).alias("day")).where("key != '' and name != ''")
    last = lambda c: F.coalesce(F.max(F.when(c, F.col("day"))), F.lit(""))
    return told.groupBy("key").agg(F.min("name").alias("name"), F.count_if("out").alias("sent"), F.count_if(~F.col("out")).alias("received"), last(F.col("out")).alias("last_sent"), last(~F.col("out")).alias("last_received"))


MAIL_COLUMNS = "message_id string, thread_id string, msg_date string, sender string, recipient string, subject string, body string, from_me boolean"


def mail_record(raw: str, me: frozenset[str]) -> tuple | None:
    """A mail as a row of ``MAIL_COLUMNS``: addresses in lower case, the date in UTC or "", the direction by ``me``; null for mail without addresses or only to oneself."""
    import email
    import email.policy
    from datetime import timezone
    from email.utils import getaddresses, parsedate_to_datetime

    message = email.message_from_string(raw, policy=email.policy.default)
    said = lambda *names: [a.lower() for _, a in getaddresses([str(message.get(n, "")) for n in names]) if a]
    sender, to = (said("From") or [""])[0], said("To", "Cc")
    others = [a for a in to if a not in me]
    if not sender and not to or sender in me and not others:
        return None
    part = message.get_body(("plain", "html"))
    try:
        body = part.get_content() if part else ""
    except (LookupError, ValueError):
        body = ""
    try:
        when = parsedate_to_datetime(str(message.get("Date", ""))).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except (TypeError, ValueError, OverflowError):
        when = ""
    root = (str(message.get("References", "")).split() or [str(message.get("In-Reply-To", "") or message.get("Message-ID", ""))])[0]
    own = str(message.get("Message-ID", "")).strip("<> ")
    return own or f"{sender}|{when}", root.strip("<> "), when, sender, others[0] if sender in me else (to or [""])[0], str(message.get("Subject", "")).strip(), body, sender in me


def read_mail_archive(spark: SparkSession, path: str, me: tuple[str, ...] = (), since: str | None = None) -> DataFrame:
    """Messages of mbox files as rows of ``MAIL_COLUMNS``, the files split at the lines that begin with ``From ``.

    Mail without addresses, and notes to oneself (``me``), are left out; of
    dated mail what was written before the day ``since``.
    """
    ship(spark)
    mine = frozenset(a.lower() for a in me)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # the first line is what is left of the line that parts mails
            rows = [r for raw in frame["value"] if (r := mail_record(raw.partition("\n")[2], mine)) is not None]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MAIL_COLUMNS.split(", ")])

    mails = spark.read.option("lineSep", "\nFrom ").text(path).where(F.trim("value") != "")
    read = mails.mapInPandas(parse, MAIL_COLUMNS)
    return read if since is None else read.where((F.col("msg_date") == "") | (F.col("msg_date") >= since))


def read_folder_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Text files under a folder with one folder per company: path, company, kind of the file name's ending, text, error; dot files are left out.

    Files of other kinds come out with an error in place of a text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name, inside = F.regexp_extract("path", r"([^/]*)$", 1), F.regexp_extract("path", rf"^.*?{re.escape(root.rstrip('/').rpartition('/')[2])}/([^/]+)/", 1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    plain = kind.isin("txt", "md", "markdown", "text", "csv", "json")
    rows = files.where(~name.startswith(".")).select("path", inside.alias("company"), kind.alias("kind"), F.when(plain, F.decode("content", "UTF-8")).alias("text"), F.when(~plain, F.concat(F.lit("no reader for "), kind)).alias("error"))
    return rows.where("company != ''")


def read_log(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """A JSON-lines log: lines that are no JSON left out, the last row by ``order`` of each key kept."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return latest(rows, key, order)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest ``order`` of each key."""
    ranked = rows.withColumn("ll_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(order))))
    return ranked.where("ll_rank = 1").drop("ll_rank")
