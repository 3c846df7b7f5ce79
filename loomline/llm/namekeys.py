"""Reading typed organisation names: folding, sector words, cores, edit distance."""

from __future__ import annotations

import re
import unicodedata

import xxhash

# Words that say nothing of which organisation is meant.
LEGAL = frozenset("inc ltd limited corp corporation holdings holding plc co company gmbh llc sa ag kg bv nv srl spa oy ab as llp lp pte pty sarl".split())
STOP = frozenset("the of and at for a an und et y de la le".split())
PLACEHOLDERS = frozenset(
    ["", "n a", "na", "none", "unknown", "tbd", "tba", "confidential", "undisclosed", "company confidential", "client of ours", "our client", "a client", "client", "stealth startup", "stealth start up", "stealth", "various", "not disclosed", "private", "private employer", "anonymous", "null", "test"]
)
# Sector words with their usual short forms; a longer form comes before its parts.
SECTORS = {
    "financial services": "financial services|financial svcs|fin services|fin svcs|fin serv|fs|financial|finance|fin",
    "university hospital": "university hospital|university hosp|univ hospital|univ hosp|uni hospital|hospital|hosp|univ",
    "research institute": "research institute|research inst|res institute|res inst|ri|research",
    "consulting group": "consulting group|consulting grp|cons group|cons grp|consulting|cons|consultants",
    "energy partners": "energy partners|energy ptnrs|energy partner|energy|ptnrs|partners",
    "software": "software|softw|sw",
    "manufacturing": "manufacturing|manufact|mfg",
    "insurance": "insurance|insur|ins",
    "laboratories": "laboratories|laboratory|labs|lab",
    "biosciences": "biosciences|bioscience|biosci|bio sci|bio",
    "aerospace": "aerospace|aerosp|aero",
    "pharmaceuticals": "pharmaceuticals|pharmaceutical|pharma|pharm",
    "technologies": "technologies|technology|techn|tech",
    "logistics": "logistics|logistic|logist",
    "health": "health|healthcare|hlth",
    "robotics": "robotics|robotic|robotix",
    "engineering": "engineering|engineers|engrg|engr|engg|eng",
    "international": "international|internat|intl",
    "systems": "systems|system|sys",
    "analytics": "analytics|analytic|analytix",
}
# Other words that are often shortened.
SHORT = {
    "natl": "national", "obs": "observatory", "fds": "foods", "semi": "semiconductors", "semicond": "semiconductors", "semiconductor": "semiconductors", "pymts": "payments", "pmts": "payments",
    "pt": "point", "ctr": "centre", "center": "centre", "dc": "data centre", "st": "saint", "mt": "mount", "inst": "institute", "ministr": "ministry", "min": "ministry", "dept": "department", "assoc": "associates",
    "svcs": "services", "svc": "services", "grp": "group", "univ": "university", "hosp": "hospital", "lib": "library", "auth": "authority", "trans": "transit", "ed": "education", "educ": "education", "coop": "cooperative",
    "archs": "architects", "arch": "architects", "shpg": "shipping", "ship": "shipping", "wks": "works", "batt": "battery", "vet": "veterinary", "sci": "science", "mun": "municipal", "munic": "municipal", "serv": "service",
}
_FORMS = sorted(((form, sector) for sector, forms in SECTORS.items() for form in forms.split("|")), key=lambda x: -len(x[0].split()))


def fold(name: str) -> str:
    """Lower case letters and digits in words parted by one space; accents, apostrophes and dots of initials dropped."""
    text = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
    text = text.replace("ø", "o").replace("ł", "l").replace("ß", "ss").replace("æ", "ae").replace("'", "").replace("’", "")
    text = re.sub(r"\b((?:[a-z]\.){2,}[a-z]?)", lambda m: m[1].replace(".", ""), text)
    text = re.sub(r"(?<=\w)\.(?=\w\b)", "", text)
    return " ".join(re.findall(r"[^\W_]+", text))


def within(a: str, b: str, k: int) -> bool:
    """Whether ``a`` becomes ``b`` by at most ``k`` insertions, deletions, replacements or swaps of neighbours; only the band of width ``2k + 1`` is filled."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return False
    far = k + 1
    before, last = [far] * (m + 1), [j if j <= k else far for j in range(m + 1)]
    for i in range(1, n + 1):
        row = [far] * (m + 1)
        row[0] = i if i <= k else far
        low, high = max(1, i - k), min(m, i + k)
        least = row[0]
        for j in range(low, high + 1):
            same = a[i - 1] == b[j - 1]
            v = last[j - 1] + (not same)
            if last[j] + 1 < v:
                v = last[j] + 1
            if row[j - 1] + 1 < v:
                v = row[j - 1] + 1
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and before[j - 2] + 1 < v:
                v = before[j - 2] + 1
            row[j] = v if v < far else far
            if v < least:
                least = v
        if least > k:
            return False
        before, last = last, row
    return last[m] <= k


#: From how many letters of the shorter word on how many edits are a slip; shorter words have to be equal.
NAME_STEPS = ((4, 1), (8, 3))
TITLE_STEPS = ((3, 1), (9, 2))


def reach(n: int, steps: tuple[tuple[int, int], ...]) -> int:
    """Edits that are a slip in a word of ``n`` letters."""
    return max((k for least, k in steps if n >= least), default=0)


def slip(a: str, b: str, steps: tuple[tuple[int, int], ...], most: int = 99) -> bool:
    """Whether two words differ by no more edits than the shorter one may have."""
    return within(a, b, min(reach(min(len(a), len(b)), steps), most))


def _key(n: int, i: int, part: str) -> int:
    return xxhash.xxh64_intdigest(f"{n}|{i}|{part}") - (1 << 63)


def segments(text: str, steps: tuple[tuple[int, int], ...]) -> list[int]:
    """Keys under which a word stands in the inverted index: its length, and number and letters of each of its k + 1 segments."""
    n = len(text)
    k = reach(n, steps)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [_key(n, i, text[cuts[i] : cuts[i + 1]]) for i in range(k + 1)] if k else []


def sought(text: str, steps: tuple[tuple[int, int], ...]) -> set[int]:
    """Keys of all segments that a word within reach may have in common with ``text``.

    Each edit is charged to one segment, a swap over a border to the one on
    its right, so one segment stays uncharged; at most ``i`` edits stand
    before it and ``k - i`` after it, which bounds its shift.  It is met as it
    stands or, where a swap crosses its right border, with its last letter
    taken from behind the border.
    """
    m, out = len(text), set()
    far = max(k for _, k in steps)
    for n in range(max(1, m - far), m + far + 1):
        parts, k, d = reach(n, steps), reach(min(n, m), steps), m - n
        if not k or abs(d) > k:
            continue
        for i in range(parts + 1):
            begin, end = n * i // (parts + 1), n * (i + 1) // (parts + 1)
            left, right = (min(i, k), min(k - i, k)) if parts == k else (k, k)
            for q in range(max(0, begin - left, begin + d - right), min(m - (end - begin), begin + left, begin + d + right) + 1):
                stop = q + end - begin
                out.add(_key(n, i, text[q:stop]))
                if stop < m and stop > q:
                    out.add(_key(n, i, text[q : stop - 1] + text[stop]))
    return out


def shouted(name: str) -> bool:
    """Whether a name is one word of capitals, as short forms are: with those a slip makes another name."""
    letters = [c for c in name if c.isalpha()]
    return len(letters) <= 6 and all(c.isupper() for c in letters) and len(fold(name).split()) == 1


def _sector_at(words: list[str], last: bool) -> tuple[str, int]:
    """The sector at one end of the words, typed right or nearly, and how many words it takes."""
    for form, sector in _FORMS:
        parts = form.split()
        own = words[-len(parts) :] if last else words[: len(parts)]
        if len(own) == len(parts) and len(words) > len(parts):
            if own == parts:
                return sector, len(parts)
    for form, sector in _FORMS:
        parts = form.split()
        own = words[-len(parts) :] if last else words[: len(parts)]
        if len(own) == len(parts) and len(words) > len(parts):
            if all(x == y or (min(len(x), len(y)) >= 2 and within(x, y, 1 if len(y) < 8 else 2) and len(y) >= 2 and (len(y) >= 4 or (len(y) == 3 and len(parts) > 1) or (len(x) == len(y) + 1 and x[0] == y[0]))) for x, y in zip(own, parts)):
                return sector, len(parts)
    return "", 0


def read_name(name: str) -> tuple[str, str, str, list[str]]:
    """A typed name as (core, the core with its parts the other way round, sector, words of the core); without words it names no organisation."""
    folded = fold(name)
    if folded in PLACEHOLDERS:
        return "", "", "", []
    bare = re.sub(r"\([^)]*\)", " ", name)
    text = name if len([w for w in fold(bare).split() if w not in LEGAL and w not in STOP]) < 2 else bare
    front = ""
    if "," in text:
        # "Insurance, Cemwil Lithriba": what stands after the comma comes first, unless it is a legal form
        head, _, tail = text.partition(",")
        tails = [w for w in fold(tail).split() if w not in LEGAL]
        if tails:
            text = f"{tail} {head}"
            front = fold(tail)
    # "ZedhamGalcoza" is two words; "GmbH" or a slip such as "rGoup" is one
    spaced = re.sub(r"(?<=[a-z]{3})(?=[A-Z][a-z]{2})", " ", text) if not front else text
    words = [w for w in fold(spaced).split() if w not in STOP]
    while len(words) > 1 and words[-1] in LEGAL:
        words.pop()
    if len(words) > 1 and words[0] in LEGAL and not _sector_at(words, True)[1]:
        words = words[1:]
    sector, taken = _sector_at(words, True)
    if taken:
        words = words[:-taken]
    else:
        sector, taken = _sector_at(words, False)
        words = words[taken:]
    words = " ".join(SHORT.get(w, w) for w in words).split()
    core = "".join(words)
    turned = "".join([*words[1:], words[0]]) if len(words) > 1 else core
    return core, turned, sector, words
