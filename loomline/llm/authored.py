"""The newly written part of mail bodies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from loomline.functions.instants import mail_instant
from loomline.operators.deliveries import bare_identifier
from loomline.operators.skew import join_key_facts
from loomline.runtime import cut, ship

# Words that notices of mail programs and firms use and letters hardly do.
MARKERS = (
    r"\b(?:confidential|confidentiel|confidencial|vertraulich|confidenziale|privileged|addressee|intended (?:only )?for|intended recipient|disclaimer|registered (?:office|number)|company number|virus(?:es)?|scanned|unsubscribe|dictated|"
    r"sent from (?:my|a)|get \w+ for \w+|envoyé depuis|enviado desde|inviato da|skickat från|monitors? (?:e-?)?mails?|outside (?:of )?(?:the|your) organi[sz]ation)\b|von meinem .* gesendet|\[external\]"
)
#: Parts of which every text that ``MARKERS`` match has one.
STEMS = (
    "confiden", "vertraulich", "privileged", "addressee", "intended ", "disclaimer", "registered ", "company number", "virus", "scanned", "unsubscribe", "dictated", "sent from ", "get ", "envoyé depuis", "enviado desde", "inviato da",
    "skickat från", "monitor", "outside ", "gesendet", "[external]",
)
#: Sentences of so many words or more are looked at.
NOTICE_WORDS = 3
#: A sentence with one of ``MARKERS`` is a notice once it recurs in so great a share of all mails, and in two of several threads.
MARKED_SHARE = 0.00001
#: Any other is one if it recurs and stands beside a marked one so often.
BESIDE = 0.9
#: A short line closes mails if it does so in this share of all mails, and mostly.
CLOSING_SHARE, CLOSING_MOSTLY = 0.001, 0.6
POSTSCRIPT = re.compile(r"(?i)^(?:p\.? ?s\.?(?: ?:)?|n\.?b\.?:?|one more thing:|postscript:) ")

_MARKED = re.compile(MARKERS)
_DIGITS = re.compile(r"[0-9]+")
_QUOTED = re.compile(r"^\s{0,4}[>|]")
_BROKEN_OFF = re.compile(r"^> ?\d+ \w")
_RULE = re.compile(r"^(?:-{2}|[*~=]{3,}|_{3,})\s*$")
_HEADER = re.compile(r"(?i)^(?:from|sent|to|cc|date|subject|re|von|gesendet|an|betreff|de|para|envoyé|à|objet|asunto) ?: \S")
_DIVIDER = re.compile(r"(?i)^(?:-{3,} ?original message ?-{3,}|-{5,} ?forwarded message ?-{5,}|begin forwarded message:|_{20,})\s*$")
_INTRO = re.compile(
    r"(?i)^(?:on .{6,100} wrote:|.{3,80} wrote on [\d./-]+:|el .{6,100} escribió:|le .{6,100} a écrit ?:|am .{6,100} schrieb .{3,80}:|quoting .{3,100}:)$"
)
_INTRO_HEAD = re.compile(r"(?i)^(?:on \w{3,9},? .*\d|el \d|le \d|am \d|quoting ).*[^.:?!]$")
_SIGN = re.compile(r"^(?:- |– |— )?[^\W\d_][\w'’.-]*(?: [\w'’.-]+){0,4}$")
_SALUTATION = re.compile(r"(?i)^(?:(?:hi|hello|hey|dear|good (?:morning|afternoon|evening)|hallo|guten tag|bonjour|hola|buenos días|estimado/a|cher|chère|liebe|lieber|sehr geehrte\w*)\b[^.?]{0,60}|[^\W\d_][\w'’-]+(?: [\w'’-]+){0,3},)[,!]?$")
_TAILED = re.compile(r"^[^\W_a-zß-öø-ÿ+].*[^.?!,:;]$|^\+\d.*[^.?!,:;]$")
_CONTACT = re.compile(r"(?i)\bp\.? ?o\.? box|@|\||\d{4}")
_TWO_SENTENCES = re.compile(r"[a-z]{2}[.?!] [A-Z¿¡]")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")
_WORD = re.compile(r"\w+")

PLAIN, OLD, BLANK, TAIL = 0, 1, 2, 3


@dataclass(frozen=True)
class Learned:
    """What recurs in a corpus: lines that close mails, and hashes of sentences that are notices."""

    closings: frozenset[str] = frozenset()
    notices: frozenset[int] = frozenset()


def closing_text(line: str) -> str:
    """A line as closings are counted: lower case, without marks at its end."""
    return line.strip().rstrip(",.! ").lower()


def sentence_hash(sentence: str) -> int:
    """Of a sentence in lower case with single spaces, numbers of a marked one alike; the same as the built-in ``xxhash64``."""
    text = " ".join(sentence.lower().split())
    if _DIGITS.search(text) and _MARKED.search(text):
        text = _DIGITS.sub("0", text)
    value = xxhash.xxh64_intdigest(text, seed=42)
    return value - (1 << 64) if value >> 63 else value


def notice_lines(lines: list[str], kind: list[int], notices: frozenset[int]) -> list[int]:
    """Plain lines all of whose sentences are notices; a sentence may run over lines."""
    out, i = [], 0
    while i < len(lines):
        if kind[i] != PLAIN:
            i += 1
            continue
        j, held, spans = i, [], []
        while j < len(lines) and kind[j] == PLAIN:
            held.append(lines[j].strip())
            j += 1
        text, at = " ".join(held), 0
        for sentence in _SENTENCE.split(text):
            begin = text.index(sentence, at)
            at = begin + len(sentence)
            spans.append((begin, at, sentence_hash(sentence) in notices))
        if any(told for *_, told in spans):
            at = 0
            for k, line in enumerate(held):
                own = [told for b, e, told in spans if b < at + len(line) and e > at]
                if own and all(own):
                    out.append(i + k)
                at += len(line) + 1
        i = j
    return out


def classify(body: str, learned: Learned = Learned()) -> list[int]:
    """A class for each line: plain, certainly not newly written, blank, or ``TAIL`` (a short closing line that depends on whether the sender repeats it)."""
    lines = [x.rstrip() for x in body.split("\n")]
    n = len(lines)
    kind = [BLANK if not x.strip() else PLAIN for x in lines]
    filled = [i for i in range(n) if kind[i] != BLANK]

    def after(i: int) -> int:
        return next((j for j in range(i + 1, n) if kind[j] != BLANK), n)

    # marked quotations
    marked = [i for i in filled if _QUOTED.match(lines[i])]
    for i in marked:
        alone = not (i and _QUOTED.match(lines[i - 1])) and not (i + 1 < n and _QUOTED.match(lines[i + 1]))
        if not (alone and _BROKEN_OFF.match(lines[i])):
            kind[i] = OLD

    low = body.lower()
    notices = notice_lines(lines, kind, learned.notices) if any(stem in low for stem in STEMS) else []
    for i in notices:
        kind[i] = OLD
    told_notice = set(notices)

    # lines that introduce earlier mail, and what they introduce
    i = 0
    while i < n:
        if kind[i] != PLAIN:
            i += 1
            continue
        text, end, forwarded = lines[i].strip(), i, False
        if _DIVIDER.match(text):
            end, forwarded = i + 1, "orward" in text
            j = after(i)
            while j < n and kind[j] == PLAIN and (_DIVIDER.match(lines[j].strip()) or _HEADER.match(lines[j].strip()) or _INTRO.match(lines[j].strip())):
                end, j = j + 1, after(j)
            if end == i + 1 and _RULE.match(text) and not forwarded:
                end = i  # a rule without a header is part of a signature
        elif _INTRO.match(text):
            end = i + 1
        elif _INTRO_HEAD.match(text) and i + 1 < n and _INTRO.match(f"{text} {lines[i + 1].strip()}"):
            end = i + 2
        elif _HEADER.match(text) and i + 1 < n and _HEADER.match(lines[i + 1].strip()) and i + 2 < n and _HEADER.match(lines[i + 2].strip()):
            end = i
            while end < n and _HEADER.match(lines[end].strip()):
                end += 1
        if end == i:
            i += 1
            continue
        for j in range(i, end):
            if kind[j] == PLAIN:
                kind[j] = OLD
        j = after(end - 1)
        if j < n and lines[j].startswith("    "):
            while j < n and (kind[j] == BLANK or lines[j].startswith("    ")):
                if kind[j] == PLAIN:
                    kind[j] = OLD
                j += 1
            i = j
        elif j < n and _QUOTED.match(lines[j]) and not forwarded:
            i = j
        else:
            # unmarked: all that follows, be it above a reply nobody can tell apart here
            for k in range(end, n):
                if kind[k] == PLAIN:
                    kind[k] = OLD
            i = n

    # closings, names and signatures of what is left
    closing = False
    for i in range(n):
        if kind[i] == BLANK:
            continue
        if kind[i] == OLD:
            if i not in told_notice:
                closing = False
            continue
        text = lines[i].strip()
        if POSTSCRIPT.match(text + " "):
            closing = False
        elif closing_text(text) in learned.closings and text[-1] not in "?:;" and (text[0].isupper() and text[-1] != "." or not i or kind[i - 1] != PLAIN) or _RULE.match(text) or (text[:2] in ("- ", "– ", "— ") and _SIGN.match(text) and len(text.split()) <= 5 and (i + 1 >= n or kind[i + 1] != PLAIN)):
            closing = True
            kind[i] = OLD
        elif closing:
            # a salutation, a whole sentence or a long line after a signature begins another text
            words, blank_before = len(text.split()), i and kind[i - 1] == BLANK
            greets = _SALUTATION.match(text) and blank_before and i + 1 < n and (words > 1 or text[-1] == ",")
            contact = _CONTACT.search(text)
            told = "@" not in text and "|" not in text and (words >= 5 and text[-1] in ".?!" or _TWO_SENTENCES.search(text))
            speaks = told or not contact and (words >= 6 and blank_before or len(text) > 75)
            if greets or speaks:
                closing = False
            else:
                kind[i] = OLD
    # short lines at the end of a plain part, which a signature without closing words leaves
    ahead = True
    for i in range(n - 1, -1, -1):
        if kind[i] == PLAIN:
            text = lines[i].strip()
            signs = _SIGN.match(text) and text[-1] not in ".?!,:;" and text[0].isupper() and not _SALUTATION.match(text)
            # titles, firms, numbers and addresses under a name
            under = i and kind[i - 1] == PLAIN and len(text.split()) <= 8 and _TAILED.match(text) and _SIGN.match(lines[i - 1].strip()) and lines[i - 1].strip()[0].isupper()
            if ahead and (signs or under):
                kind[i] = TAIL
            else:
                ahead = False
        elif kind[i] == OLD:
            ahead = True
    return kind


def units_of(body: str, kind: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Sentences of the plain lines as (hash, words), and for each line the first and last sentence it belongs to."""
    units: list[tuple[int, int]] = []
    spots: list[tuple[int, int, int]] = []
    lines, i = body.split("\n"), 0
    while i < len(lines):
        if kind[i] not in (PLAIN, TAIL):
            i += 1
            continue
        j, pieces = i, []
        while j < len(lines) and kind[j] in (PLAIN, TAIL):
            pieces.append(lines[j].strip())
            j += 1
        bounds = []
        unit, begun, held = len(units), False, []
        for piece in pieces:
            first = unit
            parts = _SENTENCE.split(piece)
            for k, part in enumerate(parts):
                held += _WORD.findall(part.lower())
                if k + 1 < len(parts) or part[-1:] in ".?!":
                    units.append((xxhash.xxh64_intdigest(" ".join(held)) - (1 << 63), len(held)))
                    held, unit = [], unit + 1
            last = unit if held else unit - 1
            bounds.append((first, last))
        if held:
            units.append((xxhash.xxh64_intdigest(" ".join(held)) - (1 << 63), len(held)))
        spots += [(i + k, a, b) for k, (a, b) in enumerate(bounds)]
        i = j
    return units, spots


_PARSED = "row_no bigint, thread string, mid string, said bigint, at bigint, sender string, old array<int>, tails array<struct<line:int,h:bigint>>, units array<struct<h:bigint,words:int>>, spots array<struct<line:int,first:int,last:int>>"
_TYPES = pa.schema([
    ("row_no", pa.int64()), ("thread", pa.string()), ("mid", pa.string()), ("said", pa.int64()), ("at", pa.int64()), ("sender", pa.string()), ("old", pa.list_(pa.int32())),
    ("tails", pa.list_(pa.struct([("line", pa.int32()), ("h", pa.int64())]))), ("units", pa.list_(pa.struct([("h", pa.int64()), ("words", pa.int32())]))),
    ("spots", pa.list_(pa.struct([("line", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))),
])


def _parse(batches: Iterator[pa.RecordBatch], learned: Learned) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = batch.to_pydict()
        out = {k: [] for k in ("old", "tails", "units", "spots")}
        for body in cols["body"]:
            kind = classify(body, learned)
            units, spots = units_of(body, kind)
            lines = body.split("\n")
            out["old"].append([i for i, k in enumerate(kind) if k == OLD])
            out["tails"].append([{"line": i, "h": xxhash.xxh64_intdigest(re.sub(r"\d+", "0", lines[i].strip().lower())) - (1 << 63)} for i, k in enumerate(kind) if k == TAIL])
            out["units"].append([{"h": h, "words": w} for h, w in units])
            out["spots"].append([{"line": i, "first": a, "last": b} for i, a, b in spots])
        yield pa.RecordBatch.from_pydict({**{k: cols[k] for k in ("row_no", "thread", "mid", "said", "at", "sender")}, **out}, schema=_TYPES)


_NAMED = re.compile(r"(?:[-–—] ?)?[^\W\d_][\w'’.-]{0,20}(?: [\w'’.-]{1,20}){0,3}(?<![.?!])$")
_EVIDENCE = pa.schema([("line", pa.string()), ("h", pa.int64()), ("n", pa.int64()), ("hits", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("marked", pa.bool_())])


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each batch: of short lines, how often they stand and how often a name follows; of sentences of mails with a marked one, how often they stand and how often beside it."""
    for batch in batches:
        lines: dict[str, list] = {}
        sentences: dict[int, list] = {}
        for sender, thread, body in zip(*(c.to_pylist() for c in batch.columns)):
            unquoted = ["" if _QUOTED.match(x) else x.strip() for x in body.split("\n")]
            filled = [x for x in unquoted if x]
            for i, x in enumerate(filled):
                if len(x) <= 32 and x[0] not in "-–—" and x[-1] not in "?:;" and x.count(" ") <= 3:
                    closes = i + 1 < len(filled) and len(filled[i + 1]) <= 40 and _NAMED.match(filled[i + 1]) is not None
                    _count(lines, closing_text(x), closes, sender)
            low = body.lower()
            if any(stem in low for stem in STEMS):
                for block in "\n".join(unquoted).split("\n\n"):
                    parts = _SENTENCE.split(block.replace("\n", " ").strip())
                    marked = [_MARKED.search(x.lower()) is not None for x in parts]
                    for i, x in enumerate(parts):
                        if x.count(" ") >= NOTICE_WORDS - 1:
                            beside = i > 0 and marked[i - 1] or i + 1 < len(parts) and marked[i + 1]
                            _count(sentences, sentence_hash(x), beside, thread)[4] |= marked[i]
        rows = [(k, None, *v) for k, v in lines.items() if k] + [(None, k, *v) for k, v in sentences.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _EVIDENCE)], schema=_EVIDENCE) if rows else pa.RecordBatch.from_pylist([], _EVIDENCE)


def _count(counts: dict, key, hit: bool, of: int) -> list:
    entry = counts.get(key)
    if entry is None:
        entry = counts[key] = [1, int(hit), of, of, False]
    else:
        entry[0] += 1
        entry[1] += hit
        entry[2], entry[3] = min(entry[2], of), max(entry[3], of)
    return entry


def learn(messages: DataFrame) -> Learned:
    """The closings and notices that recur among all ``messages`` (body, sender, thread), by counts over their unquoted lines.

    Lines are exploded and normalised.  A short line that is followed by
    another short one without a full stop, as a name is, closes; it is
    learned if ``CLOSING_MOSTLY`` of its places are such, in
    ``CLOSING_SHARE`` of all mails and of several senders.  Sentences are
    those of paragraphs with their line breaks undone.  Those with one of
    ``MARKERS`` that recur are notices, and so are others that stand
    ``BESIDE`` them nearly always, counted over the mails that hold a marker.
    Counts are taken by batch before they are shuffled.  What is
    learned, and so what is sent to the tasks, is bounded by the shares: at
    most 200,000 times the sentences, and a thousand times the short lines,
    of an average mail.
    """
    rows = messages.select(F.xxhash64("sender").alias("sender"), F.xxhash64("thread").alias("thread"), "body")
    total = rows.count()
    counts = rows.mapInArrow(_evidence, "line string, h bigint, n bigint, hits bigint, lo bigint, hi bigint, marked boolean")
    seen = cut(counts.groupBy("line", "h").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("marked").alias("marked")).where("lo != hi"))
    closing = seen.where(F.col("line").isNotNull() & (F.col("hits") >= max(3.0, total * CLOSING_SHARE)) & (F.col("hits") >= CLOSING_MOSTLY * F.col("n")))
    marked, other = F.col("marked") & (F.col("n") >= max(2.0, total * MARKED_SHARE)), (F.col("n") >= max(3.0, total * MARKED_SHARE)) & (F.col("hits") >= BESIDE * F.col("n"))
    notice = seen.where(F.col("line").isNull() & (marked | other))
    return Learned(frozenset(r.line for r in closing.select("line").collect()), frozenset(r.h for r in notice.select("h").collect()))


def not_authored(messages: DataFrame, min_run: int = 2, min_words: int = 10, min_alone: int = 16) -> DataFrame:
    """Each line (row_no, line_no) of a body that is not blank and not newly written by its sender.

    Lines are exploded and normalised with the marks of mail programs read
    (quotation marks, introductions, notices, closings).  What is left is
    ranked by date in its thread: a run of at least ``min_run`` sentences and
    ``min_words`` words, or of ``min_alone`` words, that another message of the thread wrote first, in
    the same order, is earlier mail although unmarked.  Short last lines that
    the sender repeats in another message are signatures.

    Deliveries of one identifier, and rows of equal body, are one message to
    both tests, so repeated rows do not make each other old.  Rows whose body is null or blank, or
    whose row_no is null, have no lines; messages without a thread are read
    by their marks alone; messages without a date rank by receipt; ties by
    row_no.  Groups of a hot thread or sender are only ever aggregated.
    An empty table gives an empty result; other columns are not read.
    """
    ship(messages.sparkSession)
    rows = messages.where("row_no is not null and body is not null").select(
        "row_no",
        bare_identifier("thread_id").alias("thread"),
        F.coalesce(bare_identifier("message_id"), F.concat(F.lit("row "), F.col("row_no").cast("string"))).alias("mid"),
        F.xxhash64("body").alias("said"),
        F.unix_micros(F.coalesce(mail_instant("msg_date"), F.col("received_at").cast("timestamp"))).alias("at"),
        F.lower(F.trim("sender")).alias("sender"),
        "body",
    )
    learned = learn(rows)
    parsed = cut(rows.mapInArrow(lambda batches: _parse(batches, learned), _PARSED))
    marked = parsed.select("row_no", F.explode("old").alias("line_no"))

    tails = parsed.where("sender is not null").select("row_no", "mid", F.xxhash64("sender").alias("s"), F.explode("tails").alias("t")).select("row_no", "mid", F.xxhash64("s", "t.h").alias("key"), F.col("t.line").alias("line_no"))
    repeats = tails.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("m0"), F.max("mid").alias("m1")).where("m0 != m1").select("key", "n")
    signed = join_key_facts(tails, repeats, "key", "n").select("row_no", "line_no")

    units = parsed.where("thread is not null").select("row_no", "mid", "said", "at", "thread", F.posexplode("units").alias("idx", "u")).select(
        "row_no", F.xxhash64("mid").alias("mid"), "said", F.coalesce("at", F.lit(2**62)).alias("at"), "idx", F.col("u.words").alias("words"), F.xxhash64("thread", "u.h").alias("key")
    )
    first = units.groupBy("key").agg(F.min(F.struct("at", "row_no", "mid", "said", "idx")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = join_key_facts(units, first, "key", "n").where("f.mid != mid and f.said != said and (f.at < at or (f.at = at and f.row_no < row_no))")
    seen = seen.select("row_no", "idx", "words", F.col("f.mid").alias("src"), (F.col("idx") - F.col("f.idx")).alias("shift"))
    own = Window.partitionBy("row_no").orderBy("idx")
    island = seen.withColumn("island", F.col("idx") - F.row_number().over(own))
    same = Window.partitionBy("row_no", "src", "shift").orderBy("idx")
    core = island.withColumn("run", F.col("idx") - F.row_number().over(same)).groupBy("row_no", "island", "src", "shift", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    cores = core.groupBy("row_no", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max((F.col("n") >= min_run) & (F.col("words") >= min_words) | (F.col("words") >= min_alone)).alias("good")).where("good")
    spots = parsed.select("row_no", F.explode("spots").alias("s")).select("row_no", F.col("s.line").alias("line_no"), F.col("s.first").alias("a"), F.col("s.last").alias("b"))
    unmarked = spots.join(cores, "row_no").where("lo <= a and b <= hi").select("row_no", "line_no")
    return marked.unionAll(signed).unionAll(unmarked).distinct()
