"""Quoted mail by its marks alone, and regions that fence in remote work."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomline.functions.keys import text

# Where a quoted original begins, and what says that remote work is bound to a region.
MARKS = (r"(?im)^\s*On .{0,120}\bwrote:\s*$", r"(?im)^\s*-{2,}\s*Original Message\s*-{2,}\s*$", r"(?m)^\s*_{10,}\s*$", r"(?im)^\s*From:\s.+\nSent:\s.+$")
FOOTER = r"(?is)\n\s*(--\s*\n.*|Sent from my \w+.*|This email was intended for.*|Unsubscribe:.*|You are receiving.*)\z"

FENCES = (
    r"(?i)must (?:reside|live|be located|be based)(?:\s+\w+){0,3}\s+in\s+([^.;,()]{2,60})", r"(?i)remote\s*[\-–(:]\s*([^.;)]{2,60})", r"(?i)remote\s+(?:within|in|from|across)\s+([^.;,()]{2,60})",
    r"(?i)open (?:only )?to candidates (?:in|located in|residing in)\s+([^.;,()]{2,60})", r"(?i)eligible (?:to work )?(?:only )?in\s+([^.;,()]{2,60})", r"(?i)\(([^)]{2,40})\s+(?:only|residents|based)\)",
)
MAX_FENCE_WORDS = 8


def without_quotes(c: Column | str) -> Column:
    """A mail up to its first mark of a quoted original, lines that begin with ``>`` and the footer dropped; "" for null."""
    body = text(c)
    starts = [F.when(F.regexp_instr(body, F.lit(m)) > 0, F.regexp_instr(body, F.lit(m)) - 1).otherwise(F.length(body)) for m in MARKS]
    lines = F.filter(F.split(F.left(body, F.least(*starts)), "\r\n|\r|\n"), lambda x: ~F.ltrim(x).startswith(">"))
    said = F.regexp_replace(F.array_join(lines, "\n"), FOOTER, "")
    return F.btrim(F.regexp_replace(said, r"\n{3,}", "\n\n"), F.lit(" \t\n\r"))


def fences(c: Column | str) -> Column:
    """Regions that remote work is bound to, each once, in the order of ``FENCES``; runs of more than eight words are prose."""
    every = F.flatten(F.array(*[F.regexp_extract_all(text(c), F.lit(p), F.lit(1)) for p in FENCES]))
    named = F.transform(every, lambda x: F.btrim(F.lower(F.trim(x)), F.lit("-–—:,; ")))
    return F.array_distinct(F.filter(named, lambda x: (x != "") & (F.size(F.split(x, r"\s+")) <= MAX_FENCE_WORDS)))
