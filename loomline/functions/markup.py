"""Text of HTML fragments."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Entities that boards use in texts.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&rsquo;": "’", "&lsquo;": "‘", "&ldquo;": "“", "&rdquo;": "”", "&ndash;": "–", "&mdash;": "—", "&bull;": "•", "&hellip;": "…", "&eacute;": "é", "&amp;": "&"}


def unescaped(c: Column) -> Column:
    """A text with the entities of ``ENTITIES`` resolved, ``&amp;`` last so that none is resolved twice."""
    for entity, sign in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def plain_text(c: Column | str, limit: int = 600) -> Column:
    """HTML, escaped or not, as words parted by one space, cut to ``limit`` characters; "" for null."""
    raw = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    bare = unescaped(F.regexp_replace(unescaped(raw), "<[^>]*>", " "))
    return F.rtrim(F.left(F.trim(F.regexp_replace(bare, r"\s+", " ")), F.lit(limit)))
