"""Joins against per-key statistics that stay whole under hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomline.runtime import fresh

#: A key is hot from this share of all rows on; at most ``1 / HOT_SHARE`` keys can be.
HOT_SHARE = 0.001


def join_key_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, hot_share: float = HOT_SHARE) -> DataFrame:
    """Inner join of ``rows`` with one fact row per ``key``, safe for hot keys.

    ``facts`` holds each key once; ``count`` is the number of rows the key
    has.  Keys with at least ``hot_share`` of all counted rows are at most
    ``1 / hot_share`` in number whatever the data, so their facts are
    broadcast and their rows never meet in one task; all other keys join by
    a shuffle in which no key has more than that share.

    Rows whose key is null, or has no facts, do not come out.  Columns of
    ``facts`` other than ``key`` must not clash with those of ``rows``.
    """
    (at,) = fresh([*rows.columns, *facts.columns], "ll_key")
    least = facts.agg(F.sum(count)).scalar() * F.lit(hot_share)
    hot, rest = facts.where(F.col(count) >= least).withColumnRenamed(key, at), facts.where(F.col(count) < least)
    others = [F.col(c) for c in facts.columns if c != key]
    wide = [F.col(c) for c in rows.columns]
    over_hot = rows.join(F.broadcast(hot), F.col(key) == F.col(at)).select(*wide, *others)
    # rows of hot keys have no partner on the other side, but must not be shuffled there either
    cold = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot.select(at)), F.col(key) == F.col(at), "left_anti")
    return over_hot.unionAll(cold.join(rest, key).select(*wide, *others))


def join_hot(left: DataFrame, right: DataFrame, key: str, salts: int = 16, hot_share: float = HOT_SHARE) -> DataFrame:
    """Inner join on ``key`` of two sides that may both hold a key often.

    Keys are counted on both sides first.  The rows of a hot key on the left
    are dealt to ``salts`` parts, and each of its rows on the right is sent to
    all of them; other keys have one part.  No row is dropped and the number
    of parts of a key does not depend on chance.
    """
    n, salt = fresh([*left.columns, *right.columns], "ll_n", "ll_salt")
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(n))
    hot = F.broadcast(counts.where(F.col(n) >= F.greatest(F.lit(1000.0), counts.agg(F.sum(n)).scalar() * F.lit(hot_share))).select(key, F.lit(salts).alias(n)))
    part = F.when(F.col(n).isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.lit(salts))).cast("int")
    dealt = left.join(hot, key, "left").withColumn(salt, part).drop(n)
    sent = right.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))).drop(n)
    return dealt.join(sent, [key, salt]).drop(salt)
