"""Upserts of kept tables: history, board, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STAGES = ("found", "verified", "scored")
STICKY = ("applied", "dismissed")


def _stage(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.coalesce(c, F.lit("found"))), F.lit(0))


def record_history(history: DataFrame, rows: DataFrame, today: str) -> DataFrame:
    """``history`` (id, status, reason, composite, first_seen, last_seen, note) with ``rows`` (id, status, reason, composite) recorded.

    New ids are added; known ones take the new values but keep first_seen,
    note and a status of applied or dismissed.  Of several new rows of an id
    the one with the greatest composite counts.
    """
    new = rows.where("id is not null").groupBy("id").agg(F.max(F.struct("composite", "status", "reason")).alias("n"))
    both = history.join(new, "id", "full_outer")
    fresh, sticky = F.col("n").isNotNull(), F.col("status").isin(*STICKY)
    return both.select(
        "id", F.when(fresh & ~F.coalesce(sticky, F.lit(False)), F.col("n.status")).otherwise(F.col("status")).alias("status"),
        F.when(fresh & ~F.coalesce(sticky, F.lit(False)), F.col("n.reason")).otherwise(F.col("reason")).alias("reason"),
        F.coalesce("n.composite", "composite").alias("composite"), F.coalesce("first_seen", F.lit(today)).alias("first_seen"),
        F.when(fresh, F.lit(today)).otherwise(F.col("last_seen")).alias("last_seen"), F.coalesce("note", F.lit("")).alias("note"),
    )


def merge_board(board: DataFrame, rows: DataFrame, today: str) -> DataFrame:
    """``board`` (id, stage, title, composite, first_seen, last_scored) with ``rows`` (id, stage, title, composite) merged.

    A row's stage never goes back: what comes at an earlier stage only fills
    in where it says something, and the stage stays.
    """
    new = rows.where("id is not null").groupBy("id").agg(F.max(F.struct(_stage(F.col("stage")).alias("rank"), "composite", "stage", "title")).alias("n"))
    back = F.col("n").isNotNull() & F.col("stage").isNotNull() & (F.col("n.rank") < _stage(F.col("stage")))
    pick = lambda c, blank: F.when(F.col("n").isNull(), F.col(c)).when(back, F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit(blank)), F.col(c))).otherwise(F.col(f"n.{c}"))
    return board.join(new, "id", "full_outer").select(
        "id", F.when(F.col("n").isNull() | back, F.col("stage")).otherwise(F.col("n.stage")).alias("stage"), pick("title", "").alias("title"), pick("composite", 0.0).alias("composite"),
        F.coalesce("first_seen", F.lit(today)).alias("first_seen"), F.when(F.col("n").isNotNull(), F.lit(today)).otherwise(F.col("last_scored")).alias("last_scored"),
    )


def mark_status(history: DataFrame, marks: DataFrame) -> DataFrame:
    """``history`` with the statuses and notes of ``marks`` (prefix, status, note) set where a prefix is one id, or begins just one.

    A whole id goes before a prefix of others; prefixes that begin several
    ids, or none, change nothing.  Of several marks of an id the greatest by
    (status, note) counts.
    """
    some = marks.where("prefix is not null and prefix != ''")
    whole = history.select("id").join(some, F.col("id") == F.col("prefix")).select("id", "status", "note")
    rest = some.join(history.select("id"), F.col("id") == F.col("prefix"), "left_anti")
    # ids meet their own prefixes of the lengths that marks have, so there is no comparison of all with all
    sizes = rest.select(F.length("prefix").alias("n")).distinct()
    begun = history.select("id").crossJoin(F.broadcast(sizes)).where(F.length("id") > F.col("n")).select("id", F.left("id", F.col("n")).alias("prefix"))
    single = begun.join(rest.select("prefix").distinct(), "prefix", "left_semi").groupBy("prefix").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    found = whole.unionByName(single.join(rest, "prefix").select("id", "status", "note")).groupBy("id").agg(F.max(F.struct("status", "note")).alias("m"))
    others = [c for c in history.columns if c not in ("status", "note")]
    return history.join(found, "id", "left").select(*others, F.coalesce("m.status", "status").alias("status"), F.coalesce(F.nullif("m.note", F.lit("")), "note").alias("note"))


def forget_transient(history: DataFrame) -> DataFrame:
    """``history`` without what was dropped; the dropped may be looked at again."""
    return history.where("status is null or status != 'dropped'")


def write_sorted(table: DataFrame, path: str, *order: Column) -> None:
    """Write a kept table as JSON in the order of its report, by ranges over many files."""
    table.orderBy(*order).write.mode("overwrite").json(path)


def write_snapshot(people: DataFrame, path: str, day: str) -> None:
    """Write a snapshot under its day; one that the day has already is replaced, others stay."""
    people.write.mode("overwrite").json(f"{path}/captured={day}")


def dismiss(dismissals: DataFrame, changes: DataFrame) -> DataFrame:
    """``dismissals`` (key, kind, reason, day) with ``changes`` (key, kind, reason, day, removed): added, replaced or removed by key."""
    last = changes.where("key != ''").groupBy("key").agg(F.max(F.struct("day", "removed", "kind", "reason")).alias("c"))
    kept = dismissals.join(last.select("key"), "key", "left_anti").select("key", "kind", "reason", "day")
    return kept.unionByName(last.where("not c.removed").select("key", "c.kind", "c.reason", "c.day"))

