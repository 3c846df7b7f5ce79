"""Personal information in free text: a semi-Markov conditional random field over candidate spans."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomline.runtime import ship

KINDS = ("email", "phone", "id_number", "address", "name")

# Common given names of many countries, those of them that are words or months, words that begin sentences or stand in titles and so are no names.
GIVEN = frozenset(
    "james john robert michael david william richard joseph thomas daniel matthew anthony paul andrew peter steven kevin brian george edward samuel benjamin oliver jack harry noah liam lucas ethan adam alexander max leo oscar hugo "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret emily emma olivia sophia sophie charlotte amelia isabella mia ella lucy chloe hannah laura julia anna maria alice helen kate jane ruth "
    "hans karl jürgen wolfgang klaus stefan andreas sabine monika petra heike pierre jean michel luc claire camille juliette antoine giulia marco luca giovanni francesca paolo chiara juan carlos luis miguel jose josé pedro pablo carmen ana lucía sofía "
    "joão pedro inês lars erik sven björk björn ingrid astrid kari olga ivan dmitri natasha svetlana katarzyna piotr agnieszka ahmed mohamed mohammed muhammad ali omar hassan fatima aisha layla yusuf ravi priya arjun anita rahul sanjay "
    "deepak wei li ming chen yuki hiroshi kenji sakura jin min-jun kofi kwame ama chioma ngozi emeka thabo will mark bill art rose grace faith hope joy june may april dawn penny sky drew miles".split()
)
WORDLIKE = frozenset("will mark bill art rose grace faith hope joy june may april dawn penny sky drew miles max jack".split())
COMMON = frozenset(
    "the this that these those there they them their then than thanks thank please would could should shall can may might must what when where which while who why how have has had our your you yes not now new next last all and any are ask but call "
    "come dear hi hello hey good morning afternoon evening best kind regards for from to cc subject date sent re if in into is it its just let look made make more most my no of on one only or other out over phone reply see since so some still team tell "
    "today tomorrow under until up use very was we well were with work monday tuesday wednesday thursday friday saturday sunday january february march july august september october november december manager engineer director recruiter "
    "officer analyst developer consultant specialist assistant coordinator department group office company university institute street road avenue sir madam everyone colleagues hiring committee bonjour hola hallo guten herr frau mon tue wed thu fri sat sun jan feb mar apr jun jul aug sep sept oct nov dec quoting forwarded original message begin wrote partner people warmly sincerely cordially respectfully truly yours faithfully kindly cheers greetings wishes cordialement saludos atentamente viele liebe grüße gruß saluti mvh".split()
)
# Words that end names of firms.
FIRMS = frozenset(
    "ltd inc llc plc gmbh group partners services systems technologies technology software solutions logistics insurance consulting consultants research institute laboratories labs aerospace robotics analytics engineering manufacturing energy "
    "financial bank international biosciences pharmaceuticals health hospital university college school devices trust unit centre center works foods vets transit authority observatory library review tooling desk team sales support".split()
)
WEEKDAYS = frozenset("monday tuesday wednesday thursday friday saturday sunday".split())
MONTH_BEFORE = frozenset("in from since until by of during next last early late mid till on".split())


@dataclass(frozen=True)
class Lexicon:
    """Parts of names that are known in a corpus, in lower case."""

    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()


# a space, or a line break with marks of quotation after it
_G = r"(?:[  ]|[ \t]?\r?\n[>| \t]*)"
_CITY = rf"(?:(?:Port|Lower|Upper|San|Santa|Sundry|New|Saint|North|South|East|West|Great|Mount|Lake|Fort){_G}[A-ZÀ-Þ][\w'’-]+|[A-ZÀ-Þ][\w'’-]+{_G}(?:City|Falls|Springs|Beach)\b|[A-ZÀ-Þ][\w'’-]+)"
_WORDS = rf"(?:[A-ZÀ-Þ][\w'’-]*\.?{_G}){{1,4}}"
_SIGN_AT, _TOLD_AT = re.compile("@"), re.compile(r"[(\[](?:at|AT)[)\]]|(?<=\s)AT(?=\s)")
_GAP_END, _LOCAL_BACK = re.compile(rf"{_G}$"), re.compile(r"[\w.+-]+")
_GAP = re.compile(_G)
_DOMAIN = re.compile(rf"[\w-]+(?:(?:\.|{_G}?[(\[](?:dot|DOT)[)\]]{_G}?|{_G}DOT{_G})\w[\w-]*)+")
_PHONE = re.compile(
    rf"(?<![\w+/$-])(?<!\d\.)(?:(?P<intl>\+\d{{1,3}}(?:(?:{_G}|[.-])?\(?\d{{1,5}}\)?){{1,5}})|(?P<zero>00\d{{1,3}}{_G}?\(0\){_G}?\d{{2,5}}(?:{_G}\d{{2,4}}){{1,3}})|(?P<trunk>0\d{{2,4}}{_G}\d{{3,4}}{_G}\d{{3,4}})"
    rf"|(?P<paren>\(\d{{3}}\){_G}?\d{{3}}[.-]\d{{4}})|(?P<plain>\d{{3}}(?:(?:-\d{{3}}-)|(?:\.\d{{3}}\.)|(?:{_G}\d{{3}}{_G}))\d{{4}}))(?:,?{_G}?(?:ext\.?|x|extension){_G}?\d{{1,5}})?(?![\w-]|\.\d)"
)
_ID = re.compile(
    rf"(?<![\w.+-])(?:(?P<ssn>\d{{3}}(?:-\d{{2}}-|{_G}\d{{2}}{_G})\d{{4}})|(?P<tax>\d{{2}}(?:{_G}\d{{3}}){{3}})|(?P<ni>[A-Z]{{2}}(?:{_G}?\d{{2}}){{3}}{_G}?[A-D])|(?P<passport>[A-Z]{{2}}\d{{6,8}})|(?P<licence>[A-Z]\d{{3}}-\d{{4}}-\d{{4}})|(?P<letter>\d{{8}}-?[A-Z]|[XYZ]-?\d{{7}}-?[A-Z])|(?P<fours>\d{{4}}{_G}\d{{4}}{_G}\d{{4}}))(?![\w-])"
)
_STREET = r"(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Boulevard|Blvd\.?|Court|Ct\.?|Lane|Ln\.?|Drive|Dr\.?|Place|Pl\.?|Square|Sq\.?|Terrace|Way|Close|Row|Walk|Crescent|Quay)"
_ADDRESS = re.compile(
    rf"(?<![\w$.-])(?:(?P<box>P\.?{_G}?O\.?{_G}Box{_G}\d+,{_G}{_CITY})"
    rf"|(?P<anglo>(?:(?:Flat|Apt\.?|Unit|Suite){_G}\w+,{_G})?\d{{1,5}}[A-Za-z]?{_G}{_WORDS}{_STREET}(?:,{_G}(?:Apt\.?|Flat|Unit|Suite){_G}\w+)?,{_G}{_CITY}(?:,?{_G}(?:[A-Z]{{2}}{_G}\d{{5}}|[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{_G}\d[A-Z]{{2}}))?)"
    rf"|(?P<french>\d{{1,4}},?{_G}(?:rue|avenue|boulevard|place|quai|chemin){_G}(?:(?:de{_G}la|du|des|de|d['’]){_G}?)?{_WORDS[:-5]}{{0,3}}[A-ZÀ-Þ][\w'’-]*,{_G}\d{{5}}{_G}{_CITY})"
    rf"|(?P<latin>(?:Via|Viale|Piazza|Corso|Calle|Avenida|Plaza|Paseo|Rua|Praça){_G}(?:(?:de{_G}la|del|della|dei|di|de|da|do){_G})?{_WORDS[:-5]}{{0,3}}[A-ZÀ-Þ][\w'’-]*,?{_G}(?:n\.?{_G}?)?\d{{1,4}},{_G}\d{{4,5}}(?:-\d{{3}})?{_G}{_CITY})"
    rf")(?!\w)"
)
_STREET_LAST = ("Gasse", "Weg", "Allee", "Straße", "Strasse", "Platz", "Ring", "Ufer")
_GERMAN = re.compile(
    rf"(?<![\w$.-])(?:(?P<german>(?:[A-ZÀ-Þ][\w'’-]*\.?{_G}){{1,4}}(?:Gasse|Weg|Allee|Straße|Strasse|Platz|Ring|Ufer){_G}\d{{1,4}}\w?,{_G}\d{{5}}{_G}{_CITY}))(?!\w)"
)
# runs of digits with every separator that _PHONE and _ID allow between two of them, and what they allow after the last
_SEPARATORS = "() \u00a0\t\r\n>|.+-"
_NUMBER = re.compile(r"\d[() \u00a0\t\r\n>|.+\-\d]*\d")
_NUMBER_END = re.compile(rf"(?:,?{_G}?(?:extension|ext\.?|x){_G}?\d{{1,5}}|{_G}?[A-D])?")
_LINK = re.compile(r"(?:https?://|www\.)\S+")
_CAPITAL = re.compile(r"(?:[A-Z\u00C0-\u00DE\u0100-\u024F]|v(?=[ao]n\s))[\w'’-]*(?<!-)")
_NO_NAME_BEFORE = frozenset("@./'’-_")
_LONE = re.compile(r"\n[>| \t–—-]*([^\W\d_][\w'’-]{1,24})(?=[,!.]*[ \t\r]*(?:\n|$))")
_NEXT = re.compile(rf"(?P<dot>\.)?(?P<comma>,)?{_G}(?P<word>[^\W\d_](?:[\w'’]|-(?=\w))*)")
_PARTICLE = re.compile(rf"^(?:van(?:{_G}de[rn]?)?|von|de|del|della|di|da|dos|el|al|bin|der|den)$")
# what stands right before a name: greetings and fields of headers at the start of a line, titles, and words that only people follow; and right after one
_GREET = "Hi|Hello|Dear|Hey|hi|hey|Good morning|Good afternoon|Good evening|Bonjour|Hola|Hallo|Liebe|Lieber|Cher|Chère|Caro|Cara|Ciao|Hej|Kära|Olá|Estimado|Estimada".split("|")
_HEAD = "From:|To:|Cc:|Von:|An:|De:|Da:|À:|Från:|Para:".split("|")
_TITLE = "Dr|Mr|Mrs|Ms|Prof|Herr|Frau|Mme|Sr|Sra".split("|")
_CUES = (
    "my name is|My name is|I am|I'm|this is|This is|spoke to|spoke with|speak to|speak with|talked to|hello to|regards to|meet|met|ask|asked|ask for|asked for|thank|told|invited|called|contact|interview with|interviewed by|referred by|introduced by|report to|reports to|signed by"
).split("|")
_SAID = "<|wrote|writes|schrieb|said|suggested|called|asked|joined|a écrit|escribió|ha scritto|skrev".split("|")
_BEGINS = [(w, kind) for kind, words in (("greet", _GREET), ("head", _HEAD), ("title", _TITLE), ("cue", _CUES)) for w in words]
# the ends of streets, all of which a comma follows, and beginnings of addresses in other forms; without any there is no address
_STREETS = [f"{w}{dot}," for w in "Street St Avenue Ave Road Rd Boulevard Blvd Court Ct Lane Ln Drive Dr Place Pl Square Sq Terrace Way Close Row Walk Crescent Quay".split() for dot in ("", ".")]
_STREETS += ["Box", "rue", "avenue", "boulevard", "place", "quai", "chemin", "Via", "Viale", "Piazza", "Corso", "Calle", "Avenida", "Plaza", "Paseo", "Rua", "Praça"]
_WORDS_OF: dict[str, list[str]] = {}
for _w, _k in [*_BEGINS, *((w, "said") for w in _SAID), *((w, "street") for w in _STREETS), *((w, "strasse") for w in _STREET_LAST)]:
    _WORDS_OF.setdefault(_w, []).append(_k)
try:
    import ahocorasick

    _FINDER = ahocorasick.Automaton()
    for _w, _k in _WORDS_OF.items():
        _FINDER.add_word(_w, (_w, _k))
    _FINDER.make_automaton()
except ImportError:
    _FINDER = None


def _marks(text: str) -> Iterator[tuple[int, str, list[str]]]:
    """Each place of a word that tells of names or addresses: start, word, what it may be; all in one pass where the automaton is at hand."""
    if _FINDER is not None:
        for last, (word, kinds) in _FINDER.iter(text):
            yield last + 1 - len(word), word, kinds
        return
    for word, kinds in _WORDS_OF.items():
        at = text.find(word)
        while at >= 0:
            yield at, word, kinds
            at = text.find(word, at + 1)


_GAPS = re.compile(rf"\.?{_G}")
_TOKEN = re.compile(r"[\w'’-]+")
_MAIL = re.compile(r"<[\w.+-]+@")
_PART = rf"(?:(?:van|von|de|der|den|da|di|del|el|al|bin){_G})?[^\W\d_a-zß-öø-ÿ][\w'’-]*\w"
_RUN = re.compile(rf"{_PART}(?:{_G}(?:[A-ZÀ-Þ]\.{_G})?{_PART}){{0,3}}")
_RUN_END = re.compile(rf"(?:^|(?<=[\s(>]))({_PART}(?:{_G}(?:[A-ZÀ-Þ]\.{_G})?{_PART}){{0,3}})$")
_LINE_NAME = re.compile(rf"\n[>| \t]*(?:[–—-] ?)?({_PART}(?: (?:[A-ZÀ-Þ]\. )?{_PART}){{0,3}})(?=[,]?[ \t\r]*(?:\n|$))")


class Classes(dict):
    """G given name, S known family name, I initial, P particle, C another word with a capital, or nothing; of a word, remembered."""

    def __init__(self, lexicon: Lexicon = Lexicon()):
        super().__init__()
        self.given, self.family = GIVEN | lexicon.given, lexicon.family

    def __missing__(self, word: str) -> str:
        if len(self) > 300_000:
            self.clear()
        kind = self[word] = self.of(word)
        return kind

    def of(self, word: str) -> str:
        low = word.lower()
        if _PARTICLE.match(word) or word.isupper() and len(word) > 1 and _PARTICLE.match(low):
            return "P"
        if len(word) == 1:
            return "I" if word.isupper() else ""
        if low in self.given:
            return "G"
        bare = re.sub(r"^(?:o['’]|mc)", "", low)
        parts = low.split("-")
        if word[0].isupper() and (low in self.family or bare in self.family or len(parts) > 1 and all(p in self.family for p in parts)):
            return "S"
        if len(parts) == 2 and all(p in self.given for p in parts):
            return "G"
        return "C" if word[0].isupper() and low not in COMMON and low[-2:] not in ("'s", "’s", "'m", "’m") and not any(map(str.isdigit, word)) else ""


#: Sequences of word classes that may be a name anywhere.
_SHAPES = frozenset({"G", "S", "GS", "GIS", "IS", "IIS", "GPS", "GIPS", "IPS", "G,S", "S,G", "S,I", "S,GI", "PS,G", "GG", "GGS", "GSS", "GC", "GIC", "GPC", "GIPC", "C,G", "IC", "IIC", "IPC"})


def _names(text: str, classes: Classes) -> Iterator[tuple[int, int, str, list[str]]]:
    # names in small letters stand alone on their line, or are a given name with a known family name
    for m in _LONE.finditer("\n" + text):
        if not m[1][0].isupper() and classes[m[1]] == "G":
            yield m.start(1) - 1, m.end(1) - 1, "G", [m[1]]
    for m in _CAPITAL.finditer(text):
        word = m.group()
        kind = classes[word]
        if not kind or kind == "C" and text[m.end() : m.end() + 1] != ",":
            continue
        before = text[m.start() - 1] if m.start() else " "
        if before.isalnum() or before in _NO_NAME_BEFORE:
            continue
        if kind != "P" and not word[0].isupper():
            continue
        shape, end, words = kind, m.end(), [word]
        if kind == "I" and text[end : end + 1] != ".":
            continue
        if shape in _SHAPES:
            yield m.start(), end, shape, words
        at = end
        while len(words) < 7:
            n = _NEXT.match(text, at)
            if not n:
                break
            nxt = n["word"]
            part = classes[nxt]
            if not part or (part != "P" and not nxt[0].isupper()):
                break
            if n["dot"] and shape[-1] != "I" or n["comma"] and "," in shape:
                break
            if part == "I" and text[n.end() : n.end() + 1] != ".":
                break
            if part == "C" and (shape[-1] not in "GIP" or n["comma"]):
                break
            if n["comma"]:
                # "Dear Ann van der Lee,⏎Will it …" is no "Lee, Will"
                if "\n" in n.group() and classes[_word_before(text, m.start()).capitalize()] == "G":
                    break
                shape += ","
            elif shape == "C":
                break
            if not (part == "P" and shape[-1] == "P"):
                shape += part
            words = [*words, nxt]
            at = n.end()
            stop = at + 1 if part == "I" else at
            if shape in _SHAPES:
                yield m.start(), stop, shape, words


_SMALL_NEXT = re.compile(rf"{_G}((?:(?:van|von|de|der|den){_G})*[a-zß-öø-ÿ][\w'’-]*)(?![\w@])")


def _small(text: str, classes: Classes) -> Iterator[tuple[int, int, str]]:
    """Known given names in small letters with a known family name after them: start, end, given name."""
    given = classes.given
    for first in given.intersection(text.split()):
        at = text.find(first)
        while at >= 0:
            if not (at and (text[at - 1].isalnum() or text[at - 1] in "@./'’-_")) and (n := _SMALL_NEXT.match(text, at + len(first))):
                if classes[re.split(r"[\s>|]+", n[1])[-1].capitalize()] == "S":
                    yield at, n.end(), first
            at = text.find(first, at + 1)


def _cued(text: str, marks: list[tuple[int, str, list[str]]], classes: Classes) -> Iterator[tuple[int, int, str, str]]:
    """Runs of words with a capital that no list knows, where what stands about them says that they name somebody: start, end, cue, shape."""

    def shaped(start: int, end: int, cue: str) -> Iterator[tuple[int, int, str, str]]:
        shape, ends, whole = "", [], cue in ("line", "said")
        for w in _TOKEN.finditer(text[start:end]):
            kind = classes[w.group()]
            if not kind:
                if whole:
                    return
                break
            shape += kind
            ends.append((start + w.end(), shape))
        # what ends a line, or stands before its verb, is a name as a whole or not at all
        for stop, shape in ends[-1:] if whole else ends[:5]:
            if "C" in shape and shape[-1] not in "PI" and shape not in _SHAPES:
                yield start, stop, cue, shape

    for at, word, kinds in marks:
        end = at + len(word)
        for cue in kinds:
            if cue == "said":
                # what stands before has to end with a word with a capital
                before = text[max(0, at - 80) : at]
                told = before.rstrip("  \t\r\n>|")
                last = told[told.rfind(" ") + 1 :]
                if len(told) < len(before) and last[:1].isupper() and (word != "<" or _MAIL.match(text, at)) and (run := _RUN_END.search(told)):
                    low = at - len(before)
                    yield from shaped(low + run.start(1), low + run.end(1), "said")
                continue
            if cue in ("street", "strasse") or not text[end : end + 1] or text[end].isalnum():
                continue
            if cue in ("greet", "head"):
                fits = not text[text.rfind("\n", 0, at) + 1 : at].strip(" \t>|")
            else:
                fits = not at or not (text[at - 1].isalnum() or text[at - 1] in "@./-_")
            if fits:
                gap = _GAPS.match(text, end)
                if (gap or cue == "head") and (run := _RUN.match(text, gap.end() if gap else end)):
                    yield from shaped(run.start(), run.end(), f"cue {word.lower()}" if cue == "cue" else cue)
    # the break before makes the search skip from line to line
    for m in _LINE_NAME.finditer("\n" + text):
        yield from shaped(m.start(1) - 1, m.end(1) - 1, "line")


def _alone(text: str, start: int, end: int) -> bool:
    """Whether a span is all that its line says, but for marks of quotation, a dash or a comma."""
    before, after = text[text.rfind("\n", 0, start) + 1 : start], text[end : (text + "\n").index("\n", end)]
    return not before.strip(" \t>|-–—") and not after.strip(" \t\r,!.")


_AFTER = re.compile(r"[ \u00a0]?(?:\r?\n)?[>| \t]*([\w'’]{1,24})|([,.!?:;)\]>|]|\s*$|\s*\r?\n)")


_MARKS_BEFORE = " ,.;:!?()[]{}\"'’-–—>|<*~#/\t\r\u00a0…"


def _word_before(text: str, start: int) -> str:
    """The word before a place, with at most three marks between; "^" for none on its line."""
    head = text[max(0, start - 24) : start]
    core = head.rstrip(_MARKS_BEFORE)
    if not core or core[-1] == "\n" or len(head) - len(core) > 3:
        return "^"
    return core.rsplit(None, 1)[-1].lstrip(_MARKS_BEFORE).lower() or "^"


def _label(text: str, start: int) -> str:
    """The word before a number, also over a line break."""
    head = text[max(0, start - 24) : start]
    core = head.rstrip(_MARKS_BEFORE + "\n$£€=%&")
    if not core or len(head) - len(core) > 12:
        return "^"
    word = core.rsplit(None, 1)[-1].lstrip(_MARKS_BEFORE).lower()
    return word if word[:1].isalpha() else "^"


def _word_after(text: str, end: int) -> str:
    m = _AFTER.match(text, end)
    if not m:
        return "?"
    return m[1].lower() if m[1] else ("$" if not m[2].strip() else m[2])


def _spots(text: str) -> Iterator[tuple[int, int]]:
    """Stretches within which every match of _PHONE and _ID lies.

    The digits of a match, but for an extension's, stand in one run of
    _NUMBER.  Only the form with a plus right before a digit may have fewer
    than six.  Before the first digit stand separators and at most two
    capitals, after the last what _NUMBER_END takes.
    """
    for m in _NUMBER.finditer(text):
        start, end = m.span()
        if end - start < 6 and text[start - 1 : start] != "+" and "+" not in m.group():
            continue
        while start and text[start - 1] in _SEPARATORS:
            start -= 1
        # two more characters, for what must not follow
        yield max(0, start - 2), _NUMBER_END.match(text, end).end() + 2


def _within(pattern: re.Pattern, text: str, spots: list[tuple[int, int]]) -> Iterator[re.Match]:
    """Matches that begin in one of some stretches."""
    done = 0
    for start, end in spots:
        at = max(done, start)
        while m := pattern.search(text, at, end):
            # the stretch may end within it, so it is read again without one
            whole = pattern.match(text, m.start())
            if whole:
                yield whole
            done = at = whole.end() if whole else m.start() + 1


def _paragraphs(text: str, places: list[int]) -> list[tuple[int, int]]:
    """Begin and end of the paragraphs in which some places, in order, lie."""
    out: list[tuple[int, int]] = []
    for at in places:
        if not out or at >= out[-1][1]:
            end = text.find("\n\n", at)
            out.append((text.rfind("\n\n", 0, at) + 1, end if end >= 0 else len(text)))
    return out


@lru_cache(100_000)
def _number_features(kind: str, form: str, size: str, label: str) -> tuple[str, ...]:
    return kind, f"{kind}:{form}:{size}", f"{kind}<{label}"


@lru_cache(100_000)
def _cue_features(cue: str, shape: str, after: str, firm: bool, told: str) -> tuple[str, ...]:
    kind = cue.split()[0]
    own = (f"cue:{cue}",) if kind != cue else ()
    return "name", f"cue:{kind}", f"cue:{kind}:{shape}", f"cue>{after}", f"firm:{firm}", *own, *((f"line:{shape}:{told}",) if told else ())


class _NameFeatures(dict):
    """Features of a name by all that they depend on, remembered."""

    def __missing__(self, key: tuple) -> tuple[str, ...]:
        if len(self) > 200_000:
            self.clear()
        feats = self[key] = self.of(*key)
        return feats

    @staticmethod
    def of(shape: str, one: bool, word: bool, june: bool, before: str, after: str, case: str, alone: bool) -> tuple[str, ...]:
        feats = ["name", f"name:{shape}"]
        w = "w" if word else "n"
        if one:
            follows = after.capitalize() if case == "upper" else after
            feats += [f"one:{w}:{shape}", f"one:{w}<{before}", f"one:{w}>{follows}", f"one:{w}>:{case}", f"one:{w}:{before if before[0] == '^' else 'in'}:{case}"]
            if alone:
                feats.append(f"one:{w}:alone")
            if after in WEEKDAYS:
                feats.append(f"one:{w}>weekday")
            if june and before in MONTH_BEFORE:
                feats.append("month")
            if shape == "S":
                feats.append(f"family<{before}")
        else:
            feats += [f"many:{w}", f"many<{before}" if before in ("the", "a", "^") else "many<other"]
            if shape[-1] == "C":
                feats += [f"guess<{before}", f"guess>{after if len(after) < 3 or after in WEEKDAYS else 'word'}"]
        return tuple(feats)


_NAME_FEATURES = _NameFeatures()


def candidates(text: str, classes: Classes | None = None) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """Candidate spans with their kind and features of the whole span."""
    classes = _PLAIN if classes is None else classes
    out: list[tuple[int, int, str, tuple[str, ...]]] = []
    if "://" in text or "www." in text:
        out += [(m.start(), m.end(), "link", ("link",)) for m in _LINK.finditer(text)]
    # the sign in the middle is rare, so both sides are read from there
    signs = [*_SIGN_AT.finditer(text)]
    if "AT" in text or "(at)" in text or "[at]" in text:
        signs += _TOLD_AT.finditer(text)
    for m in signs:
        plain, at = m.group() == "@", m.start()
        gap = None if plain else _GAP.match(text, m.end())
        domain = _DOMAIN.match(text, gap.end() if gap else m.end())
        if not domain:
            continue
        begin = at
        if plain:
            if n := _LOCAL_BACK.match(text[max(0, at - 64) : at][::-1]):
                begin -= n.end()
            while begin and at - begin >= 64 and (text[begin - 1].isalnum() or text[begin - 1] in "_.+-"):
                begin -= 1
            fits = begin < at and (text[at - 1].isalnum() or text[at - 1] == "_")
        else:
            before = _GAP_END.search(text, max(0, at - 40), at)
            last = before.start() if before else at
            begin = last
            while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.+-"):
                begin -= 1
            fits = begin < last and (text[last - 1].isalnum() or text[last - 1] == "_")
        if fits:
            out.append((begin, domain.end(), "email", ("email", "email:" + ("plain" if plain else "told"))))
    if spots := list(_spots(text)):
        for pattern, kind in ((_PHONE, "phone"), (_ID, "id_number")):
            for m in _within(pattern, text, spots):
                form, digits = m.lastgroup, sum(map(str.isdigit, m.group()))
                size = "few" if digits < 7 else "many" if digits > 20 else "fit"
                out.append((m.start(), m.end(), kind, _number_features(kind, form, size, _label(text, m.start()))))
    marks = list(_marks(text))
    if "," in text:
        # no address goes over an empty line, so those paragraphs are read that have a street
        # a street in French follows its number
        places = [at for at, word, kinds in marks if "street" in kinds and (not word.islower() or any(x.isdigit() for x in text[max(0, at - 12) : at]))]
        german = [at for at, _, kinds in marks if "strasse" in kinds]
        for pattern, begin, end in [*((_ADDRESS, a, b) for a, b in _paragraphs(text, places)), *((_GERMAN, a, b) for a, b in _paragraphs(text, german))]:
            for m in pattern.finditer(text, begin, end):
                out.append((m.start(), m.end(), "address", ("address", f"address:{m.lastgroup}")))
    for start, end, shape, words in _names(text, classes):
        before, after = _word_before(text, start), _word_after(text, end)
        if text[max(0, start - 2) : start].strip()[-1:] in (".", "?", "!"):
            before = "^."
        low, rest = words[0].lower(), text[end : end + 2].strip()
        case = "end" if not rest else "digit" if rest[0].isdigit() else "lower" if rest[0].islower() else "upper" if rest[0].isupper() else "mark"
        out.append((start, end, "name", _NAME_FEATURES[shape, len(words) == 1, low in WORDLIKE, low == "june", before, after, case, len(words) == 1 and _alone(text, start, end)]))
    for start, end, cue, shape in dict.fromkeys(_cued(text, marks, classes)):
        told = ""
        if cue == "line":
            above = text[max(0, start - 200) : text.rfind("\n", 0, start) + 1].rstrip(" \t\r\n>|–—-")
            upper = above[above.rfind("\n") + 1 :].strip(" >|\t–—-")
            told = "^" if not upper else "text" if len(upper) > 32 or upper[-1] in ".?:;" else "comma" if upper[-1] in ",!" else "title" if upper.split()[-1][0].isupper() and " " in upper else "word"
        last = text[start:end].rstrip(_MARKS_BEFORE)
        after = _word_after(text, end)
        out.append((start, end, "name", _cue_features(cue, shape, after if len(after) < 3 else "firm" if after in FIRMS else "word", _TOKEN.findall(last)[-1].lower() in FIRMS, told)))
    for start, end, first in _small(text, classes):
            out.append((start, end, "name", ("name", "small", f"small:{'w' if first in WORDLIKE else 'n'}")))
    return out


_PLAIN = Classes()


#: Two segments are neighbours if no more characters than these part them.
NEAR = 3


def pair_of(text: str, one: tuple, next_: tuple) -> str:
    """The feature of two neighbours: their kinds, and what parts them."""
    gap = text[one[1] : next_[0]]
    return f"{one[2]}+{next_[2]}:{'line' if chr(10) in gap else gap.strip()[:1]}"


class Field:
    """A semi-Markov conditional random field: weights of features of whole segments and of pairs of neighbours, and what follows from them."""

    def __init__(self, weights: dict[str, float], lexicon: Lexicon = Lexicon()):
        self.weights, self.classes = weights, Classes(lexicon)
        self.scores: dict[tuple[str, ...], float] = {}

    def score(self, feats: tuple[str, ...]) -> float:
        known = self.scores.get(feats)
        if known is None:
            if len(self.scores) > 200_000:
                self.scores.clear()
            get = self.weights.get
            known = self.scores[feats] = sum(get(f, 0.0) for f in feats)
        return known

    def best(self, text: str) -> list[tuple[int, int, str, tuple[str, ...]]]:
        """The segments of the labelling with the greatest score.

        The score of a labelling is the sum of those of its segments and of
        its pairs of neighbours; text between segments scores nothing.
        Segments are bounded by the candidates, which are taken in the order
        of their ends: the best labelling that ends with one follows the best
        of all that lies before it, or one that ends with a neighbour.
        """
        known, score = self.scores, self.score
        scored = []
        for c in candidates(text, self.classes):
            s = known.get(c[3])
            if s is None:
                s = score(c[3])
            if s > -2:
                scored.append((c, s))
        if len(scored) < 2:
            return [c for c, s in scored if s > 0]
        scored.sort(key=lambda x: (x[0][1], x[0][0]))
        ends = [c[1] for c, _ in scored]
        gains, chains, back, taken = [0.0], [], [], []
        for i, (c, s) in enumerate(scored):
            j = i
            while j and ends[j - 1] > c[0]:
                j -= 1
            # what ends farther off is followed for nothing, a neighbour at the price of the pair
            k = j - 1
            while j and ends[j - 1] >= c[0] - NEAR:
                j -= 1
            most, prior = gains[j], -1 - j
            while k >= j:
                chain = chains[k] + self.weights.get(pair_of(text, scored[k][0], c), 0.0)
                if chain > most:
                    most, prior = chain, k
                k -= 1
            chains.append(most + s)
            back.append(prior)
            # of equal sums the one with the longer last segment
            take = chains[i] >= gains[-1] and chains[i] > 0
            taken.append(take)
            gains.append(chains[i] if take else gains[-1])
        out, i = [], len(scored)
        while i > 0:
            if not taken[i - 1]:
                i -= 1
                continue
            k = i - 1
            while True:
                out.append(scored[k][0])
                if back[k] < 0:
                    i = -1 - back[k]
                    break
                k = back[k]
        return out[::-1]

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        return [(a, b, kind) for a, b, kind, _ in self.best(text) if kind != "link"] if text else []


WEIGHTS = Path(__file__).with_name("pii_weights.json")
_LOADED: list[Field] = []


def field() -> Field:
    """The trained field, read once per Python worker."""
    if not _LOADED:
        from importlib.resources import files

        _LOADED.append(Field(json.loads(files("loomline.llm").joinpath(WEIGHTS.name).read_text())))
    return _LOADED[0]


_FIELDS: dict[tuple[int, int, int], Field] = {}


def shared_field(weights: dict[str, float], known: Lexicon) -> Field:
    """One field per weights, lexicon and Python worker, so that what it remembers serves all tasks of the worker."""
    key = hash(known.given), hash(known.family), hash(frozenset(weights.items()))
    if key not in _FIELDS:
        _FIELDS.clear()
        _FIELDS[key] = Field(weights, known)
    return _FIELDS[key]


#: A part of a name is known from this share of all names on, so a lexicon has at most 300,000 parts or so.
KNOWN_SHARE = 0.00001


def lexicon(*names: DataFrame) -> Lexicon:
    """The given and family names among typed names of people (one column each), "First Last" or "Last, First".

    Parts are counted over all names; a part is given or family by where it
    stands more often.  Initials, particles and parts of a letter are left
    out, as are texts of more than five words, which are no names.
    """
    every = names[0].toDF("name")
    for n in names[1:]:
        every = every.unionAll(n.toDF("name"))
    turned = F.regexp_replace(F.trim("name"), r"^([^,]+),\s*(.+)$", "$2 $1")
    words = F.filter(F.split(F.lower(turned), r"\s+"), lambda w: (F.length(w) > 1) & ~w.rlike(r"\.$|[\d@<>/]") & ~w.isin("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "el", "al", "bin", "dr", "mr", "mrs", "ms"))
    parts = every.where(F.col("name").isNotNull()).select(words.alias("w")).where(F.size("w").between(2, 5))
    each = F.concat(F.transform(F.slice("w", 1, F.size("w") - 1), lambda x: F.struct(x.alias("part"), F.lit(1).alias("given"))), F.array(F.struct(F.element_at("w", -1).alias("part"), F.lit(0).alias("given"))))
    counts = parts.select(F.explode(each).alias("p")).groupBy("p.part").agg(F.count(F.lit(1)).alias("n"), F.sum("p.given").alias("given"))
    least = counts.agg(F.sum("n")).scalar() * F.lit(KNOWN_SHARE)
    rows = counts.where(F.col("n") >= least).select("part", (F.col("given") * 2 > F.col("n")).alias("g")).collect()  # at most 1 / KNOWN_SHARE parts
    family = {x for r in rows if not r.g for x in (r.part, re.sub(r"^(?:o['’]|mc)", "", r.part), *r.part.split("-")) if len(x) > 1}
    return Lexicon(frozenset(r.part for r in rows if r.g) - COMMON, frozenset(family) - COMMON)


def personal_spans(texts: DataFrame, field_name: str, key: str, text: str, known: Lexicon = Lexicon()) -> DataFrame:
    """Each place of personal information in a column: field_name, row_key, kind, start_at, end_at.

    Each text is read whole where it stands, without a shuffle.  ``known``
    are names of the corpus, see ``lexicon``; others are found by their
    shape and what stands about them.  Null and empty texts have no places;
    repeated rows come out as often as they stand there; a null key comes out
    as null; other columns are not read.
    """
    return personal_places(texts, key, {field_name: text}, known)


def personal_places(texts: DataFrame, key: str, fields: dict[str, str], known: Lexicon = Lexicon()) -> DataFrame:
    """``personal_spans`` of several columns (name in the result: column), which are read in one pass."""
    ship(texts.sparkSession)
    weights = json.loads(WEIGHTS.read_text())

    names = list(fields)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared_field(weights, known)
        for batch in batches:
            for n, column in zip(names, batch.columns[1:]):
                rows: list[int] = []
                found: list[tuple[int, int, str]] = []
                for i, value in enumerate(column.to_pylist()):
                    if value:
                        spans = crf.spans(value)
                        found += spans
                        rows += [i] * len(spans)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n] * len(rows), pa.string()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array([k for *_, k in found], pa.string()), pa.array([a for a, _, _ in found], pa.int32()), pa.array([b for _, b, _ in found], pa.int32())],
                    ["field_name", "row_key", "kind", "start_at", "end_at"],
                )

    some = texts.select(F.col(key).cast("bigint").alias("row_key"), *[F.col(c).alias(f"text_{i}") for i, c in enumerate(fields.values())])
    return some.mapInArrow(find, "field_name string, row_key bigint, kind string, start_at int, end_at int")


def masked(texts: DataFrame, text: str, to: str = "masked", known: Lexicon = Lexicon()) -> DataFrame:
    """``texts`` with a column in which each place of personal information in ``text`` is replaced by ``[KIND]``; null stays null."""
    ship(texts.sparkSession)
    weights = json.loads(WEIGHTS.read_text())

    @F.arrow_udf("string")
    def mask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        crf = shared_field(weights, known)
        for values in batches:
            yield pa.array([None if x is None else replaced(x, crf.spans(x)) for x in values.to_pylist()], pa.string())

    return texts.withColumn(to, mask(text))


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])
