"""Keys under which differently typed companies, titles, addresses and people meet."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that do not tell companies, or titles, apart.
COMPANY_NOISE = "inc llc ltd limited corp corporation co company holdings group technologies technology labs laboratory laboratories national the".split()
TITLE_NOISE = r"senior|sr|staff|principal|lead|ii|iii|iv|i|1|2|3|4|level|l\d|remote|us|usa|contract|full[\s-]?time"
TOKEN_NOISE = (
    "the inc llc ltd corp corporation company co group holdings national laboratory laboratories labs lab technologies technology systems solutions services and of for university institute center centre"
).split()
# Words that stand in so many names of employers that they tell none apart.
GENERIC = (
    "scientific sciences science technologies technology systems solutions services international global partners holdings ventures capital associates consulting research institute university college school "
    "energy health medical digital software data company corporation industries enterprises america usa worldwide biosciences pharmaceuticals therapeutics"
).split()
LEGAL = "inc|llc|ltd|limited|corp|corporation|co|company|plc|gmbh|sa|nv|bv|ag|pty|holdings"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def company_key(c: Column | str) -> Column:
    """Lower case words of a company without punctuation and noise words; "" for null."""
    bare = F.regexp_replace(text(c), r"[^\p{L}\p{N}_\s&-]", " ")
    quiet = F.regexp_replace(bare, rf"(?i)\b({'|'.join(COMPANY_NOISE)})\b", " ")
    return F.lower(F.trim(F.regexp_replace(quiet, r"[\s_-]+", " ")))


def title_key(c: Column | str) -> Column:
    """Lower case words of a title without punctuation, level, contract and remote words; "" for null."""
    quiet = F.regexp_replace(F.regexp_replace(text(c), r"[^\p{L}\p{N}_\s]", " "), rf"(?i)\b({TITLE_NOISE})\b", " ")
    return F.lower(F.trim(F.regexp_replace(quiet, r"\s+", " ")))


def host_of(url: Column | str) -> Column:
    """The host of an address, with or without scheme; user, port and ``www.`` dropped."""
    rest = F.regexp_replace(F.trim(text(url)), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":.*$", ""), r"^www\.", "")


def path_of(url: Column | str) -> Column:
    rest = F.regexp_replace(F.trim(text(url)), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), r"/+$", "")


def url_key(url: Column | str, requisition_host: str = r"(^|\.)dayworks\.example$") -> Column:
    """Host and path; on hosts that spell place and title into the path, host, site and requisition."""
    host, path = host_of(url), path_of(url)
    req = F.regexp_extract(path, r"_([A-Za-z]{0,4}[-_]?\d[\w-]*)$", 1)
    site = F.regexp_extract(path, r"^/+([^/]+)", 1)
    short = F.concat(host, F.lit("/"), F.when(site == "job", "").otherwise(site), F.lit("/job/"), req)
    return F.when(host.rlike(requisition_host) & path.contains("/job/") & (req != ""), short).otherwise(F.concat(host, path))


def registrable_domain(host: Column) -> Column:
    """The last two labels of a host, three under country suffixes such as ``co.uk``."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    compound = F.get(parts, n - 2).isin("co", "com", "org", "net", "ac", "gov", "edu") & (F.length(F.get(parts, n - 1)) == 2)
    take = F.when(compound, 3).otherwise(2)
    return F.when(n <= 2, host).otherwise(F.array_join(F.slice(parts, n - take + 1, take), "."))


def person_key(c: Column | str) -> Column:
    """``in:`` profile, ``mail:`` address or ``name:`` of a person, the first that the text holds; "" for nothing."""
    low = F.lower(F.trim(text(c)))
    slug = F.regexp_extract(low, r"/in/([^/?#]+)", 1)
    return F.when(low == "", "").when(slug != "", F.concat(F.lit("in:"), slug)).when(low.contains("@"), F.concat(F.lit("mail:"), low)).otherwise(F.concat(F.lit("name:"), F.regexp_replace(low, r"\s+", " ")))


def employer_key(c: Column | str) -> Column:
    key = company_key(c)
    return F.when(key == "", "").otherwise(F.concat(F.lit("co:"), key))


def posting_id(url: Column | str, company: Column | str, title: Column | str) -> Column:
    """Twelve hexadecimal digits of the address key, or else of company and title."""
    key = url_key(url)
    return F.left(F.sha1(F.when(key != "", key).otherwise(F.concat_ws("|", company_key(company), title_key(title)))), F.lit(12))


def company_tokens(c: Column | str) -> Column:
    """Words of a company that tell it apart: lower case, noise dropped, three letters or more."""
    return F.filter(F.split(F.lower(text(c)), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*TOKEN_NOISE))


def is_employer_host(host: Column, company: Column | str) -> Column:
    """Whether a host is a company's own: one of its telling words in the last three labels, or a label that is the acronym of its name."""
    labels = F.split(host, r"\.")
    core = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")).otherwise(host)
    flat, tokens = F.regexp_replace(core, "[^a-z0-9]", ""), company_tokens(company)
    words = F.filter(F.split(F.lower(text(company)), "[^a-z0-9]+"), lambda w: ~w.isin("", "the", "of", "and", "for", "a"))
    acronym = F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")
    told = F.exists(tokens, lambda t: flat.contains(t)) | ((F.length(acronym) >= 3) & F.array_contains(labels, acronym))
    return (host != "") & (F.size(tokens) > 0) & told


def legal_words(c: Column | str) -> Column:
    """Lower case words of a company without legal forms."""
    return F.filter(F.split(F.lower(F.regexp_replace(text(c), rf"(?i)\b({LEGAL})\b\.?", " ")), "[^a-z0-9]+"), lambda w: w != "")


def board_slugs(c: Column | str) -> Column:
    """Up to three names a board may have: words joined, words hyphened, first of several words."""
    words = legal_words(c)
    every = F.array(F.array_join(words, ""), F.array_join(words, "-"), F.when(F.size(words) > 1, F.get(words, F.lit(0))).otherwise(""))
    return F.slice(F.array_distinct(F.filter(every, lambda s: F.length(s) > 1)), 1, 3)


def is_specific(slug: Column, company: Column | str) -> Column:
    """Whether a board's name carries all words of a company, not only the first."""
    words = legal_words(company)
    return (F.size(words) <= 1) | (slug == F.array_join(words, "")) | (slug == F.array_join(words, "-"))


def same_employer(a: Column | str, b: Column | str) -> Column:
    """Whether two names are one employer's: equal keys, or telling words in common that make at least half of the shorter name."""
    ka, kb = company_key(a), company_key(b)
    ta, tb = F.array_distinct(F.split(ka, r"\s+")), F.array_distinct(F.split(kb, r"\s+"))
    shared = F.filter(F.array_intersect(ta, tb), lambda w: ~w.isin(*GENERIC) & (F.length(w) > 3))
    return F.when((ka == "") | (kb == ""), False).when(ka == kb, True).otherwise((F.size(shared) > 0) & (F.size(shared) / F.least(F.size(ta), F.size(tb)) >= 0.5))


def profile_slug(url: Column | str) -> Column:
    """The name under which a profile address knows a person, in lower case; "" for other addresses."""
    return F.lower(F.regexp_extract(F.trim(text(url)), r"(?i)/in/([^/?#]+)", 1))


def connection_identity(url: Column | str, name: Column | str, email: Column | str) -> Column:
    """The profile address, or else name and mail address, in lower case."""
    at = F.regexp_replace(text(url), "/+$", "")
    return F.lower(F.when(text(url) != "", at).otherwise(F.concat(text(name), F.lit("|"), text(email))))


def holds_word(c: Column | str, word: str) -> Column:
    """Whether a text has a word, unbroken by letters, digits or underscores on either side."""
    import re

    return text(c).rlike(rf"(?U)(?<!\w){re.escape(word)}(?!\w)")
