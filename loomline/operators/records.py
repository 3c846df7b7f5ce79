"""Record processing over postings, mail and contacts: gates, joins, folds, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomline.functions import dates, keys, scores, wording
from loomline.operators.skew import join_key_facts
from loomline.runtime import cut, fresh


def gate(state: Column, on_unknown: str = "include") -> Column:
    """A tri-state check (true, false, null) as pass or not; null follows the policy."""
    return F.coalesce(state, F.lit(on_unknown == "include"))


def freshness(posted: Column, today: Column, limit: int, live: Column | None = None) -> tuple[Column, Column]:
    """Whether a posting is fresh, and why; an undated one is if it is known to be live."""
    age = F.datediff(today, posted)
    undated = F.lit(False) if live is None else F.coalesce(live, F.lit(False))
    ok = F.when(age.isNull(), undated).otherwise(age <= limit)
    why = F.when(age.isNull(), F.when(undated, "no date, but live").otherwise("no date")).when(age < 0, "posted today").when(age > limit, F.format_string("posted %d days ago (limit %d)", age, F.lit(limit))).otherwise(F.format_string("posted %d day(s) ago", age))
    return ok, why


def pay_state(low: Column, high: Column, floor: int | None, ceiling: int | None) -> Column:
    """Whether a stated range reaches the floor and stays under the ceiling; null if none is stated."""
    ok = F.lit(True)
    if floor is not None:
        ok = ok & (high >= floor)
    if ceiling is not None:
        ok = ok & (low <= ceiling)
    return F.when(low.isNull(), None).otherwise(ok)


def title_state(title: Column, without: list[str], required: list[str]) -> Column:
    """Whether a title has none of some words and one of others; null for an empty title."""
    low = F.lower(keys.text(title))
    bad = F.lit(False)
    for w in without:
        bad = bad | low.contains(w)
    good = F.lit(not required)
    for w in required:
        good = good | low.contains(w)
    return F.when(F.trim(low) == "", None).otherwise(~bad & good)


def deduplicated(postings: DataFrame, id_column: str, pair: list[str], order: str, seen: DataFrame | None = None) -> DataFrame:
    """Postings without repetitions: by ``order`` each is kept unless one kept before it has its id or its pair of non-empty keys.

    A dropped row claims neither its id nor its pair.  Rows with equal id and
    pair fall to the first of them at once, by an aggregate.  The rest is
    decided in rounds: a row that is first of both its groups among those
    undecided is kept, and what shares a key with a kept one is dropped;
    rounds end when none is undecided, however many that takes.  ``seen``
    are rows kept earlier, with the same columns; nothing that repeats them
    is kept.  Null ids and orders are values like others; an empty table
    gives an empty result.
    """
    whole = (F.col(pair[0]) != "") & (F.col(pair[1]) != "")
    keyed = lambda t: t.select(F.xxhash64(F.coalesce(F.col(id_column).cast("string"), F.lit("\u0000"))).alias("ll_i"), F.when(whole, F.xxhash64(*pair)).alias("ll_p"), *([F.col(order).alias("ll_o")] if order in t.columns else []))
    open_ = cut(keyed(postings).groupBy("ll_i", "ll_p").agg(F.min("ll_o").alias("ll_o")))
    if seen is not None:
        old = keyed(seen)
        open_ = cut(open_.join(old.select("ll_i").distinct(), "ll_i", "left_anti").join(old.select("ll_p").where("ll_p is not null").distinct(), "ll_p", "left_anti"))
    kept = None
    while True:
        first_i, first_p = (open_.where(f"{k} is not null").groupBy(k).agg(F.min("ll_o").alias(f"{k}_first"), F.count(F.lit(1)).alias(f"{k}_n")) for k in ("ll_i", "ll_p"))
        by_i = join_key_facts(open_, first_i, "ll_i", "ll_i_n").drop("ll_i_n")
        by_p = join_key_facts(by_i, first_p, "ll_p", "ll_p_n").drop("ll_p_n").unionByName(by_i.where("ll_p is null").withColumn("ll_p_first", F.col("ll_o")))
        told = cut(by_p.withColumn("ll_keep", (F.col("ll_o") == F.col("ll_i_first")) & (F.col("ll_o") == F.col("ll_p_first"))))
        now = told.where("ll_keep").select("ll_i", "ll_p", "ll_o")
        kept = now if kept is None else kept.unionAll(now)
        rest = told.where("not ll_keep").select("ll_i", "ll_p", "ll_o")
        rest = rest.join(now.select("ll_i"), "ll_i", "left_anti").join(now.select("ll_p").where("ll_p is not null"), "ll_p", "left_anti")
        open_ = cut(rest)
        if open_.isEmpty():
            break
    (at,) = fresh(postings.columns, "ll_at")
    return postings.join(kept.select(F.col("ll_o").alias(at)), F.col(order) == F.col(at), "left_semi")


def best_per_key(df: DataFrame, key: str, order: list[Column], keep: int = 1) -> DataFrame:
    """The best ``keep`` rows of each key, the leader with the number of those held back (``also``).

    The rank is limited before the shuffle, task by task, and rows are
    counted by an aggregate, so a key with a third of all rows brings
    ``keep`` rows and one count per task.
    """
    ranked = df.withColumn("ll_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("ll_rank") <= keep)
    counts = df.groupBy(F.col(key).alias("ll_key")).agg(F.count(F.lit(1)).alias("ll_n"))
    held = F.when(F.col("ll_rank") == 1, F.greatest(F.lit(0), F.col("ll_n") - keep)).otherwise(0).cast("int")
    return ranked.join(counts, F.col(key).eqNullSafe(F.col("ll_key"))).withColumn("also", held).drop("ll_rank", "ll_n", "ll_key")


def scored(postings: DataFrame, today: str) -> DataFrame:
    """Age, recency and composite of postings."""
    age = F.datediff(F.lit(today).cast("date"), dates.written_date("posted"))
    fresh = scores.recency(age)
    return postings.withColumns({"age_days": age, "recency": F.bround(fresh).cast("int"), "composite": scores.composite(F.col("fit_score"), F.col("likelihood"), fresh)})


def thread_dates(messages: DataFrame) -> DataFrame:
    """Per thread: first and last mail, direction of the last, whether the user replied, and the run of own mails at its end.

    The run counts own mails after the last one of the other side, so two
    aggregates do what a walk through the thread would.
    """
    rows = messages.where("thread_id is not null").select("thread_id", F.struct("received_at", "row_no").alias("at"), F.coalesce("from_me", F.lit(False)).alias("me"))
    whole = rows.groupBy("thread_id").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.max_by("me", "at").alias("last_mine"), F.bool_or("me").alias("replied"), F.max(F.when(~F.col("me"), F.col("at"))).alias("theirs"))
    mine = rows.where("me").join(whole.select("thread_id", "theirs"), "thread_id").where("theirs is null or at > theirs").groupBy("thread_id").agg(F.count(F.lit(1)).alias("chased"))
    return whole.join(mine, "thread_id", "left").select("thread_id", F.col("lo.received_at").alias("first_at"), F.col("hi.received_at").alias("last_at"), "last_mine", "replied", F.coalesce("chased", F.lit(0)).cast("int").alias("chased"))
