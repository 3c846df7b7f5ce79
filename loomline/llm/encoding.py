"""The whole corpus as token ids, and back."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from loomline.llm.bpe import decode_stream, encoder, vocabulary
from loomline.runtime import ship


def token_ids(text: Column, path: str | None = None) -> Column:
    """Ids of ``text`` without special tokens, whose strings are ordinary text; null and empty texts give an empty list."""
    file = path or vocabulary()

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(file).encode
        for texts in batches:
            flat, ends = array("i"), [0]
            for x in texts.to_pylist():
                flat.extend(encode(x))
                ends.append(len(flat))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))

    return ids(text)


def token_text(ids: Column, path: str | None = None) -> Column:
    """The text of token ids; a null list gives null."""
    file = path or vocabulary()

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merges = encoder(file).m
        for lists in batches:
            yield pa.array([None if x is None else "".join(decode_stream(merges, x)) for x in lists.to_pylist()], pa.string())

    return text(ids)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` of every row; repeated rows come out as often as they stand there.

    No shuffle: each batch of rows is encoded where it is read.  Very long
    texts stream through a transducer of bounded state; a null or empty text
    has the empty list; an empty table gives an empty result.
    """
    ship(documents.sparkSession)
    return documents.select(F.col(key).alias(key), token_ids(F.col(text), path).alias("ids"))
