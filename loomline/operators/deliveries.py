"""Keeping one copy of messages that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomline.operators.skew import join_key_facts
from loomline.runtime import cut, fresh


def bare_identifier(column: str | Column) -> Column:
    """An identifier without surrounding spaces and angle brackets; null where nothing remains."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.regexp_replace(c, r"^[\s<>]+|[\s<>]+$", ""), F.lit(""))


def frequencies(rows: DataFrame, key: str, order: str, count: str, first: str) -> DataFrame:
    """Per identifier the number of rows and the smallest ``order``; combined before the shuffle."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(count), F.min(order).alias(first))


#: Bits of the filter of repeated identifiers: 4,096 bitmaps of 4 KB, 16 MB whatever the data.
FILTER_BITS = 1 << 27


def _bit(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def repeated_filter(repeated: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """Bitmaps (ll_bucket, ll_bitmap) with the bit of each repeated key set; ``bits / 8`` bytes at most."""
    bit = _bit(key, bits)
    return repeated.groupBy(F.bitmap_bucket_number(bit).alias("ll_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("ll_bitmap"))


def maybe_repeated(rows: DataFrame, filters: DataFrame, key: str, to: str, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with a flag: false for rows whose key surely is not repeated; no shuffle, as the bitmaps are broadcast."""
    bucket, bitmap = fresh([*rows.columns, to], "ll_bucket", "ll_bitmap")
    known = F.broadcast(filters.toDF(bucket, bitmap))
    at = F.bitmap_bit_position(_bit(key, bits))
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (at % 8).cast("int")) == 1
    joined = rows.join(known, F.bitmap_bucket_number(_bit(key, bits)) == F.col(bucket), "left")
    return joined.withColumn(to, F.coalesce(hit, F.lit(False))).drop(bucket, bitmap)


def redelivered(messages: DataFrame, identifier: str = "message_id", row: str = "row_no") -> DataFrame:
    """The rows that must go: ``row`` of each delivery after the first of its identifier.

    Identifiers are split by their frequency.  Those that occur once pass:
    a filter of 16 MB over the repeated ones, broadcast, tells them where they
    are read, and they are not shuffled.  Only repeated identifiers are ranked
    by ``row``, and all but the first rank come out.  The rank is decided
    against the smallest ``row`` of the group, so no group is gathered in a
    task.

    ``row`` has to be unique.  Rows without an identifier (null, empty or only
    spaces and brackets) and rows whose ``row`` is null are no deliveries of
    anything and never come out; an empty table gives an empty result; other
    columns, whatever their names, are not read.
    """
    key, at, n, first, maybe = "ll_key", "ll_row", "ll_n", "ll_first", "ll_maybe"
    rows = messages.select(bare_identifier(identifier).alias(key), F.col(row).alias(at))
    repeated = cut(frequencies(rows, key, at, n, first).where(F.col(n) > 1))
    few = maybe_repeated(rows, repeated_filter(repeated, key), key, maybe).where(maybe).drop(maybe)
    return join_key_facts(few, repeated, key, n).where(F.col(at) > F.col(first)).select(F.col(at).alias(row))


def keep_one(messages: DataFrame, stored: DataFrame | None = None, identifier: str = "message_id", row: str = "row_no") -> DataFrame:
    """All of ``messages``, and of ``stored`` before them, with one row per identifier.

    Singletons and rows without an identifier pass where they are read, told
    from the others by a broadcast filter of bounded size; what the filter
    cannot tell goes with the repeated identifiers, of which the row of rank
    one by ``row`` passes; all are united.  Rows with the same identifier and
    the same ``row`` (a table read twice) are ties: one of them is kept.
    Columns of ``messages`` come out as they are.
    """
    rows = messages if stored is None else stored.select(*messages.columns).unionAll(messages)
    key, n, first, maybe = fresh(rows.columns, "ll_key", "ll_n", "ll_first", "ll_maybe")
    keyed = rows.withColumn(key, bare_identifier(identifier))
    repeated = cut(frequencies(keyed, key, row, n, first).where(F.col(n) > 1))
    told = maybe_repeated(keyed, repeated_filter(repeated, key), key, maybe)
    pass_by, rest = told.where(~F.col(maybe)), told.where(maybe).drop(maybe)
    # keys that the filter could not tell are counted too, with the repeated ones
    counted = frequencies(rest, key, row, n, first)
    ranked = join_key_facts(rest, counted, key, n).where(F.col(row).eqNullSafe(F.col(first))).dropDuplicates([key])
    return pass_by.select(*rows.columns).unionAll(ranked.select(*rows.columns))
