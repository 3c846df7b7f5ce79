"""Reading the instants that mail headers write in several forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mail_instant(column: str | Column) -> Column:
    """The instant a mail date names, or null where it names none.

    Read are ISO dates with ``T`` or a space, with or without seconds,
    fractions and an offset (UTC without one), the mail form
    ``Wed, 03 Sep 2025 14:27:56 +0530`` with or without a weekday, and a bare
    number as milliseconds since the epoch.  Dates that do not exist are null.
    """
    text = F.trim(F.col(column) if isinstance(column, str) else column)
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"
    mail = r"^(?:[A-Za-z]{3,9},\s*)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{2}:\d{2}(?::\d{2})?)\s*(Z|UTC|GMT|[+-]\d{2}:?\d{2})?.*$"
    # A session in another zone must not shift dates without an offset.
    zoned = F.regexp_replace(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"\s+(?=[+-]\d{2}:\d{2}$)", "")
    bare = text.rlike(r"[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$") | text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    of_iso = F.try_to_timestamp(F.when(bare, F.concat(F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00"))).otherwise(text), F.lit("Z"))).otherwise(zoned))
    part = lambda k: F.regexp_extract(text, mail, k)
    clock = F.when(F.length(part(4)) == 5, F.concat(part(4), F.lit(":00"))).otherwise(part(4))
    zone = F.when(part(5).rlike(r"^[+-]"), F.regexp_replace(part(5), ":", "")).otherwise(F.lit("+0000"))
    of_mail = F.try_to_timestamp(F.concat_ws(" ", part(1), F.initcap(part(2)), part(3), clock, zone), F.lit("d MMM yyyy HH:mm:ss xx"))
    # fifteen digits of milliseconds still fit a timestamp
    of_number = F.timestamp_millis(F.try_to_number(text, F.lit("9" * 15)).cast("bigint"))
    return F.when(text.rlike(r"^\d{1,15}$"), of_number).when(text.rlike(iso), of_iso).when(text.rlike(mail), of_mail)
