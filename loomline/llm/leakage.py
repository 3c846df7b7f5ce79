"""Evaluation passages that stand in the corpus, found by winnowed fingerprints."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomline.llm.winnowing import window_minima
from loomline.operators.deliveries import maybe_repeated, repeated_filter
from loomline.operators.skew import join_hot
from loomline.runtime import cut, ship

#: Bytes of evaluation texts and their fingerprints that may be sent to every task; beyond that both sides are shuffled.
MAX_BROADCAST = 64_000_000
#: Bytes that a fingerprint takes as Python holds it, and a character of a passage split into words.
PRINT_BYTES, CHAR_BYTES = 200, 16

WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Unbroken runs of letters and digits in lower case; none for null."""
    return WORD.findall(text.lower()) if text else []


class _Hashes(dict):
    """Remembered hashes of words; forgets all once it holds a million."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def fingerprints(texts: list[list[str]], gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of words: the index of the list, the place and the hash of each fingerprint.

    Of each ``window`` successive grams of ``gram`` words the one with the
    smallest hash is kept, the first of equals, so two lists with a common
    run of ``gram + window - 1`` words have a fingerprint of it in common.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    flat = np.fromiter((_HASHES[w] for x in texts for w in x), np.uint64, int(sizes.sum()))
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(flat) < gram + window - 1:
        return empty
    grams = np.zeros(len(flat) - gram + 1, np.uint64)
    for k in range(gram):
        grams = (grams ^ flat[k : k + len(grams)]) * _ODD
        grams ^= grams >> np.uint64(29)
    _, where = window_minima(grams, window)
    owner = np.repeat(np.arange(len(texts)), sizes)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    starts = np.arange(len(where))
    inside = owner[starts] == owner[starts + gram + window - 2]  # the window lies in one list
    kept = np.unique(where[inside])
    return owner[kept], kept - begins[owner[kept]], grams[kept]


def extends(ours: list[str], at: int, theirs: list[str], there: int, span: int) -> bool:
    """Whether the words about a hit run equal for ``span`` words or more."""
    if ours[at] != theirs[there]:
        return False
    left = right = 0
    while left < min(at, there) and ours[at - left - 1] == theirs[there - left - 1]:
        left += 1
    while at + right < len(ours) and there + right < len(theirs) and ours[at + right] == theirs[there + right]:
        right += 1
    return left + right >= span


def leaked(documents: DataFrame, items: DataFrame, span: int = 12, gram: int = 6, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Each doc_id and item_id whose text and passage share at least ``span`` consecutive words.

    Fingerprints of both sides meet by hash; a hit counts if it extends to a
    run of ``span`` words.  The items and their fingerprints are measured
    first: up to ``max_broadcast`` bytes they go to every task and the
    documents are read once without a shuffle.  Beyond that a filter of
    16 MB drops the documents' fingerprints that no item has, the rest joins
    by a shuffle that splits hot fingerprints, and the texts are fetched again
    for the hits alone.  Both ways give the same rows.

    Null, empty and shorter texts have no hits, a repeated passage leaks
    under each of its item_ids, repeated rows come out once, an empty table
    on either side gives an empty result, and further columns are not read.
    """
    spark, window = documents.sparkSession, span - gram + 1
    ship(spark)
    docs = documents.select("doc_id", "text")
    tests = items.select("item_id", F.col("passage").alias("text"))
    doc_type, item_type = docs.schema["doc_id"].dataType.simpleString(), tests.schema["item_id"].dataType.simpleString()

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = batch.column(0), [words_of(x) for x in batch.column(1).to_pylist()]
            owner, place, value = fingerprints(words, gram, window)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), pa.array(place.astype(np.int32)), pa.array(value.view(np.int64))], ["key", "place", "h"])

    prints = cut(tests.mapInArrow(prints_of, f"key {item_type}, place int, h bigint"))
    held = tests.join(prints.select(F.col("key").alias("item_id")).distinct(), "item_id", "left_semi")
    size = prints.count() * PRINT_BYTES + (held.agg(F.sum(F.length("text"))).first()[0] or 0) * CHAR_BYTES
    if size <= max_broadcast:
        passages = dict(held.collect())  # with the fingerprints at most max_broadcast bytes
        table = defaultdict(list)
        for item, place, h in prints.collect():
            table[h].append((item, place))
        sent = spark.sparkContext.broadcast((dict(table), {k: words_of(x) for k, x in passages.items()}, np.array(sorted(table), np.int64)))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, passages, known = sent.value
            for batch in batches:
                words = [words_of(x) for x in batch.column(1).to_pylist()]
                owner, place, value = fingerprints(words, gram, window)
                value = value.view(np.int64)
                hits = np.flatnonzero(np.isin(value, known))
                pairs = {(o, item) for o, p, h in zip(owner[hits].tolist(), place[hits].tolist(), value[hits].tolist()) for item, there in table[h] if extends(words[o], p, passages[item], there, span)}
                rows = sorted(pairs)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([o for o, _ in rows], pa.int64())), pa.array([i for _, i in rows], out_item)], ["doc_id", "item_id"])

        out_item = to_arrow_type(tests.schema["item_id"].dataType)
        return docs.mapInArrow(find, f"doc_id {doc_type}, item_id {item_type}").distinct()

    ours = docs.mapInArrow(prints_of, f"key {doc_type}, place int, h bigint").select(F.col("key").alias("doc_id"), "h", F.col("place").alias("at"))
    theirs = prints.select(F.col("key").alias("item_id"), "h", F.col("place").alias("there"))
    hits = cut(maybe_repeated(ours, repeated_filter(theirs, "h"), "h", "maybe").where("maybe").drop("maybe"))
    met = cut(join_hot(hits, theirs, "h").drop("h"))
    meet = docs.join(met, "doc_id").join(tests.withColumnRenamed("text", "passage"), "item_id")

    @F.pandas_udf("boolean")
    def holds(text, at, passage, there):
        import pandas as pd

        return pd.Series([extends(words_of(a), int(i), words_of(b), int(j), span) for a, i, b, j in zip(text, at, passage, there)])

    return meet.where(holds("text", "at", "passage", "there")).select("doc_id", "item_id").distinct()
