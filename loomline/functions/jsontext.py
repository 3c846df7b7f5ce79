"""JSON values that stand in prose."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_DECODER = json.JSONDecoder()


def first_json(text: str | None) -> str | None:
    """The first JSON object or list of a text, as compact JSON: the whole text, what a code fence holds, or what starts at the first bracket that parses; null for none."""
    if not text:
        return None
    fence = _FENCE.search(text)
    for candidate in (text, fence.group(1) if fence else ""):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(value, (dict, list)):
            return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    for m in re.finditer(r"[{\[]", text):
        try:
            value, _ = _DECODER.raw_decode(text, m.start())
        except (ValueError, RecursionError):
            continue
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    return None


def json_in_text(column: Column) -> Column:
    """``first_json`` in Arrow batches; brackets that nest cannot be matched by an expression."""

    @F.arrow_udf("string")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([first_json(x) for x in texts.to_pylist()], pa.string())

    return found(column)
