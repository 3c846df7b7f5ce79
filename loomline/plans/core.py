"""Queries over deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.operators.deliveries import keep_one, redelivered
from loomline.runtime import read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return redelivered(read_table(spark, folder, "messages"))


def p1_kept(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "messages")
    stored, new = rows.where("batch_no = 0"), rows.where("batch_no > 0")
    return keep_one(new, stored)


QUERIES = {"p1_found": p1_found, "p1_kept": p1_kept}

_BARE = r"nullif(regexp_replace(message_id, '^[\s<>]+|[\s<>]+$', '', 'g'), '')"

SQL = {
    "p1_found": f"""
        select row_no from (
          select row_no, {_BARE} as k, row_number() over (partition by {_BARE} order by row_no) as rn from messages)
        where k is not null and rn > 1""",
    "p1_kept": f"""
        select * exclude (k, rn) from (
          select *, {_BARE} as k, row_number() over (partition by {_BARE} order by row_no) as rn from messages)
        where k is null or rn = 1""",
}
