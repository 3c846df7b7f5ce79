"""Exact spans of at least a given length that stand in more than one record."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from loomline.llm.winnowing import window_minima
from loomline.operators.skew import join_key_facts
from loomline.runtime import cut, ship

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Characters hashed at once; a longer text is hashed alone.
_CHUNK = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hashes of any stretch of an array of characters, each in constant time."""

    def __init__(self, chars: np.ndarray):
        n = len(chars)
        powers, inverse = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
        powers[0] = inverse[0] = 1
        powers, self.inverse = np.cumprod(powers), np.cumprod(inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(chars.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * powers[:n])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _chunks(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Indices of texts with the joint array of their characters and its borders."""
    held, size = [], 0
    for i, text in enumerate(texts):
        if text:
            held.append(i)
            size += len(text)
            if size >= _CHUNK:
                yield _joined(held, texts)
                held, size = [], 0
    if held:
        yield _joined(held, texts)


def _joined(held: list[int], texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
    chars = np.frombuffer("".join(texts[i] for i in held).encode("utf-32-le", "surrogatepass"), np.uint32)
    return held, chars, np.concatenate([[0], np.cumsum([len(texts[i]) for i in held])])


def _anchors(texts: list[str | None], span: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows of ``span`` characters with one anchor: owner, first and last window start, hash of the anchor, hash of the whole run."""
    for held, chars, borders in _chunks(texts):
        if len(chars) < span:
            continue
        rolling = RollingHash(chars)
        grams = np.arange(len(chars) - gram + 1)
        least, where = window_minima(rolling.of(grams, grams + gram), span - gram + 1)
        owner = np.repeat(np.arange(len(held)), np.diff(borders))
        inside = owner[: len(where)] == owner[span - 1 :]
        turn = np.ones(len(where), bool)
        turn[1:] = (where[1:] != where[:-1]) | ~inside[:-1] | (owner[1 : len(where)] != owner[: len(where) - 1])
        first = np.flatnonzero(turn & inside)
        # a run ends where the next begins or where windows stop lying in one text
        stops = np.flatnonzero(np.append(turn | ~inside, True))
        last = stops[np.searchsorted(stops, first, "right")] - 1
        anchor, text = where[first], owner[first]
        whole = _mix(rolling.of(first, last + span) ^ _mix(((anchor - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64)) ^ least[first])
        begin = borders[text]
        yield np.array(held)[text], first - begin, last - begin, least[first].view(np.int64), whole.view(np.int64)


def shared_stretches(documents: DataFrame, span: int = 256, gram: int = 128) -> DataFrame:
    """Each longest stretch (doc_id, start_at, end_at) covered by spans of ``span`` characters that another document has too.

    Every window of ``span`` characters is anchored at its gram of smallest
    hash; windows of a text with the same anchor follow each other, and such
    a run is one unit.  Units are grouped by their digest globally: a unit
    that stands in another document too is shared as a whole.  Only where an
    anchor is common but units differ, at the borders of shared passages, are
    single windows hashed, by one document for each different unit, and
    grouped the same way; each counts for the smallest and largest doc_id of
    its unit.  Groups are reduced to the smallest and largest
    doc_id before any shuffle, so a passage in a third of all documents costs
    one row per task, and no pairs of documents are formed.  A longer
    ``gram`` means more anchors, but fewer that texts of one template share
    without sharing a span; half the span is the default.

    Equality is that of 64-bit digests of the characters within equal 64-bit
    anchors.  Null and shorter texts have no stretch; a span repeated in one
    document only is not shared; repeated rows (equal doc_id) are the same
    document; an empty table gives an empty result.  doc_id must be unique to
    a text for offsets to mean anything; null doc_ids are left out.
    """
    ship(documents.sparkSession)
    docs = documents.select("doc_id", "text").where("doc_id is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, first, last, anchor, whole in _anchors(batch.column(1).to_pylist(), span, gram):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(anchor), pa.array(whole)], ["doc_id", "lo", "hi", "anchor", "unit"])

    runs = cut(docs.mapInArrow(units, f"doc_id {kind}, lo int, hi int, anchor bigint, unit bigint"))
    classes = runs.groupBy("anchor", "unit").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    groups = classes.groupBy("anchor").agg(F.min("low").alias("lowest"), F.max("high").alias("highest"), F.count(F.lit(1)).alias("n_units"), F.max(F.col("low") == F.col("high")).alias("border"))
    facts = join_key_facts(classes, groups.where("lowest < highest").drop("lowest", "highest"), "anchor", "n_units")
    facts = facts.select("unit", "n", "low", "high", (F.col("low") < F.col("high")).alias("everywhere"), "border")
    hits = cut(join_key_facts(runs.select("doc_id", "lo", "hi", "unit"), facts, "unit", "n"))

    wanted = hits.where("border and doc_id = low").groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi", "high")).alias("runs"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, runs_of = batch.column(0), batch.column(2).to_pylist()
            for held, chars, borders in _chunks(batch.column(1).to_pylist()):
                rolling = RollingHash(chars)
                rows = [(k, borders[k], r["lo"], r["hi"]) for k, i in enumerate(held) for r in runs_of[i]]
                k, begin, lo, hi = (np.array(x) for x in zip(*rows))
                high = pa.array([r["high"] for i in held for r in runs_of[i]], keys.type)
                sizes = hi - lo + 1
                start = np.repeat(lo, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                at = np.repeat(begin, sizes) + start
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(np.array(held)[np.repeat(k, sizes)])), pa.array(start.astype(np.int32)), pa.array(rolling.of(at, at + span).view(np.int64)), high.take(pa.array(np.repeat(np.arange(len(rows)), sizes)))],
                    ["doc_id", "start_at", "digest", "high"],
                )

    single = cut(docs.dropDuplicates(["doc_id"]).join(wanted, "doc_id").select("doc_id", "text", "runs").mapInArrow(windows, f"doc_id {kind}, start_at int, digest bigint, high {kind}"))
    # a window stands in all documents of its unit, not only in the one that digests it
    seen = single.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("digest", "n")
    parts = join_key_facts(single.where("doc_id = high").select("doc_id", "start_at", "digest"), seen, "digest", "n")
    covered = hits.where("everywhere").select("doc_id", F.col("lo").alias("start_at"), (F.col("hi") + span).alias("end_at")).unionAll(parts.select("doc_id", "start_at", (F.col("start_at") + span).alias("end_at")))
    return merged(covered)


def merged(intervals: DataFrame) -> DataFrame:
    """Intervals (doc_id, start_at, end_at) with those that overlap or touch made one."""
    own = Window.partitionBy("doc_id").orderBy("start_at", "end_at")
    reach = F.max("end_at").over(own.rowsBetween(Window.unboundedPreceding, -1))
    numbered = intervals.withColumn("new", F.when(F.col("start_at") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "island").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at")).select("doc_id", "start_at", "end_at")


def shared_amounts(documents: DataFrame, span: int = 256) -> DataFrame:
    """Of each document with a text: its length and how many of its characters are shared."""
    part = shared_stretches(documents, span).groupBy("doc_id").agg(F.sum(F.col("end_at") - F.col("start_at")).alias("shared"))
    whole = documents.where("doc_id is not null and text is not null").select("doc_id", F.length("text").alias("n_chars"))
    return whole.join(part, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("shared", F.lit(0)).cast("int").alias("n_shared"))


_BLANKS = re.compile(r"[ \t\r\f\v]+")


def unit_text(line: str) -> str:
    """A line as it is compared: lower case, runs of blanks one space, none at its ends."""
    return _BLANKS.sub(" ", line).strip(" ").lower()


def repeated_lines(documents: DataFrame, least: int = 40) -> DataFrame:
    """Each line that an earlier place of the corpus has already (doc_id, start_at, end_at, first_doc, first_at).

    Lines are normalised and their 128-bit digests grouped globally.  Of each
    digest the earliest place by doc_id and offset is kept; the others come
    out with the offsets of the line in the original text, and where it
    stands first.  Groups are reduced to count and first place before the
    shuffle, and the digests that repeat meet the lines by
    ``join_key_facts``, so a line in a third of all documents is one row per
    task.  Only lines of ``least`` characters or more, normalised, are looked
    at.

    Null and empty texts have no lines; repeated rows (equal doc_id and text)
    are one place; null doc_ids are left out; an empty table gives an empty
    result; further columns are not read.
    """
    ship(documents.sparkSession)
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, start, end, digest = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                at = 0
                for line in text.split("\n"):
                    unit = unit_text(line)
                    if len(unit) >= least:
                        owner.append(i)
                        start.append(at)
                        end.append(at + len(line))
                        digest.append(xxhash.xxh3_128_digest(unit))
                    at += len(line) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(digest, pa.binary())], ["doc_id", "start_at", "end_at", "digest"])

    units = docs.mapInArrow(lines, f"doc_id {kind}, start_at int, end_at int, digest binary")
    place = F.struct("doc_id", "start_at")
    facts = cut(units.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1"))
    later = join_key_facts(units, facts, "digest", "n").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start_at") != F.col("first.start_at")))
    return later.select("doc_id", "start_at", "end_at", F.col("first.doc_id").alias("first_doc"), F.col("first.start_at").alias("first_at")).distinct()
