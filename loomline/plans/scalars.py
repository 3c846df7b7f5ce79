"""Queries over column functions: keys, dates, wording."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomline.functions import dates, keys, wording
from loomline.runtime import read_table

#: The day on which ages count.
TODAY = "2026-05-01"


def _select(table: str, key: str, /, **columns: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return read_table(spark, folder, table).select(key, *[c().alias(name) for name, c in columns.items()])

    return query


def sql_company(x: str) -> str:
    noise = "|".join(keys.COMPANY_NOISE)
    bare = rf"regexp_replace(coalesce({x}, ''), '[^\p{{L}}\p{{N}}_\s&-]', ' ', 'g')"
    return rf"lower(trim(regexp_replace(regexp_replace({bare}, '(?i)\b({noise})\b', ' ', 'g'), '[\s_-]+', ' ', 'g')))"


def sql_title(x: str) -> str:
    bare = rf"regexp_replace(coalesce({x}, ''), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
    return rf"lower(trim(regexp_replace(regexp_replace({bare}, '(?i)\b({keys.TITLE_NOISE})\b', ' ', 'g'), '\s+', ' ', 'g')))"


def sql_host(x: str) -> str:
    rest = rf"regexp_replace(trim(coalesce({x}, '')), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    return rf"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({rest}, '^([^/?#]*)', 1)), '^.*@', ''), ':.*$', ''), '^www\.', '')"


def sql_path(x: str) -> str:
    rest = rf"regexp_replace(trim(coalesce({x}, '')), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    return rf"regexp_replace(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '/+$', '')"


def sql_url(x: str) -> str:
    h, p = sql_host(x), sql_path(x)
    req = rf"regexp_extract({p}, '_([A-Za-z]{{0,4}}[-_]?\d[\w-]*)$', 1)"
    site = rf"regexp_extract({p}, '^/+([^/]+)', 1)"
    return rf"case when regexp_matches({h}, '(^|\.)dayworks\.example$') and contains({p}, '/job/') and {req} <> '' then {h} || '/' || (case when {site} = 'job' then '' else {site} end) || '/job/' || {req} else {h} || {p} end"


def sql_date(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    forms = r"""when regexp_full_match(T, '\d{4}-\d{1,2}-\d{1,2}') then try_strptime(T, '%Y-%m-%d')
        when regexp_full_match(T, '\d{4}/\d{1,2}/\d{1,2}') then try_strptime(T, '%Y/%m/%d')
        when regexp_full_match(T, '\d{1,2}/\d{1,2}/\d{4}') then try_strptime(T, '%m/%d/%Y')
        when regexp_full_match(T, '[A-Za-z]{3} \d{1,2}, \d{4}') then try_strptime(T, '%b %d, %Y')
        when regexp_full_match(T, '[A-Za-z]{4,9} \d{1,2}, \d{4}') then try_strptime(T, '%B %d, %Y')
        when regexp_full_match(T, '\d{1,2} [A-Za-z]{3} \d{4}') then try_strptime(T, '%d %b %Y')
        when regexp_full_match(T, '\d{1,2} [A-Za-z]{4,9} \d{4}') then try_strptime(T, '%d %B %Y')
        when regexp_full_match(T, '\d{4}-\d{1,2}') then try_strptime(T, '%Y-%m')
        when regexp_matches(T, '^\d{4}-\d{2}-\d{2}.') then try_strptime(left(T, 10), '%Y-%m-%d')"""
    return f"cast(case {forms.replace('T,', t + ',')} end as date)".replace("left(T", f"left({t}")


_WORDS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9+#]+'), lambda w: length(w) > 1 and w not in (" + ", ".join(f"'{w}'" for w in wording.TITLE_STOP) + "))"


def sql_tokens(x: str) -> str:
    return f"list_transform({_WORDS.format(f"coalesce({x}, '')")}, lambda w: regexp_replace(w, '^(.{{4,}}?)(?:ing|ers|er|s)+$', '\\1'))"


def _ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"


def _says(x: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


_LOW = "lower(coalesce(summary, ''))"
_POST = "coalesce(title, '') || ' ' || coalesce(summary, '')"
_post = lambda: F.concat_ws(" ", keys.text("title"), keys.text("summary"))
_pay = lambda: F.concat_ws(" ", keys.text("salary"), keys.text("summary"))
_KINDS = "case " + " ".join(f"when regexp_matches({_POST}, '{p}') then '{n}'" for n, p in wording.EMPLOYMENT) + " end"


def n44_excerpt(spark: SparkSession, folder: str, limit: int = 200) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    cut = F.length("text") > limit
    return docs.select("doc_id", F.when(cut, F.concat(F.left("text", F.lit(limit)), F.lit(" [cut]"))).otherwise(F.coalesce("text", F.lit(""))).alias("excerpt"))


def n45_document_kind(spark: SparkSession, folder: str) -> DataFrame:
    name = F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]*)$", 1))
    kind = F.when(name.rlike(r"resume|r.sum.|\bcv\b"), "resume").when(name.rlike("cover"), "cover_letter").when(name.rlike(r"job[^a-z0-9]*desc|posting|requisition|role"), "job_description")
    kind = kind.when(name.rlike("recruiter|thread|email|interview|call|prep|screen|correspondence"), "correspondence").otherwise("other")
    return read_table(spark, folder, "documents").select("doc_id", kind.alias("kind_of_name"))


def e13_nationwide(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "postings").select("pos", wording.is_nationwide("place").alias("nationwide"))


QUERIES = {
    "n01_normalize_company": _select("postings", "pos", company_key=lambda: keys.company_key("company")),
    "n02_normalize_title": _select("postings", "pos", title_key=lambda: keys.title_key("title")),
    "n03_canonical_url": _select("postings", "pos", url_key=lambda: keys.url_key("url")),
    "n04_parse_date": _select("postings", "pos", posted_on=lambda: dates.written_date("posted")),
    "n05_feed_date": _select("postings", "pos", posted_on=lambda: dates.feed_date("posted")),
    "n10_posting_id": _select("postings", "pos", id=lambda: keys.posting_id("url", "company", "title")),
    "n11_age_days": _select("postings", "pos", age_days=lambda: F.datediff(F.lit(TODAY).cast("date"), dates.written_date("posted"))),
    "n12_host_of": _select("postings", "pos", host=lambda: keys.host_of("url")),
    "n13_host_matches": _select("postings", "pos", on_board=lambda: (keys.host_of("url") == "dayworks.example") | keys.host_of("url").endswith(".dayworks.example")),
    "n14_domain_of": _select("postings", "pos", domain=lambda: keys.registrable_domain(keys.host_of("url"))),
    "n16_person_key": _select("contacts", "contact_id", person=lambda: keys.person_key("full_name")),
    "n17_employer_key": _select("contacts", "contact_id", employer=lambda: keys.employer_key("company")),
    "n18_board_slugs": _select("applications", "application_id", slugs=lambda: F.array_join(keys.board_slugs("company"), " ")),
    "n21_company_tokens": _select("postings", "pos", tokens=lambda: F.array_join(keys.company_tokens("company"), " ")),
    "n22_title_tokens": _select("postings", "pos", tokens=lambda: F.array_join(wording.title_tokens("title"), " ")),
    "n24_title_fragments": _select("postings", "pos", fragments=lambda: F.array_join(wording.title_fragments("title"), "|")),
    "n29_message_domain": _select("messages", "row_no", domain=lambda: F.lower(F.regexp_extract(F.coalesce("sender", F.lit("")), r"@([\w.\-]+)", 1))),
    "n30_counterpart": _select("messages", "row_no", counterpart=lambda: F.lower(F.trim(F.coalesce(F.when(F.col("from_me"), F.col("recipient")).otherwise(F.col("sender")), F.lit(""))))),
    "n31_clean_subject": _select("messages", "row_no", subject=lambda: wording.clean_subject("subject")),
    "n32_message_text": _select("messages", "row_no", text=lambda: F.concat_ws("\n", F.nullif("subject", F.lit("")), F.nullif("snippet", F.lit("")), F.nullif("body", F.lit("")))),
    "n35_unwrap": _select("messages", "row_no", text=lambda: wording.unwrapped("body")),
    "n41_contact_key": _select("contacts", "contact_id", key=lambda: F.concat(F.lower(F.trim(keys.text("full_name"))), F.lit("|"), keys.company_key("company"))),
    "n44_excerpt": n44_excerpt,
    "n45_document_kind": n45_document_kind,
    "e01_salary": _select("postings", "pos", low=lambda: wording.salary_range(_pay())["low"], high=lambda: wording.salary_range(_pay())["high"]),
    "e02_employment_type": _select("postings", "pos", employment=lambda: wording.employment_type(_post())),
    "e04_clearance": _select("postings", "pos", clearance=lambda: wording.needs_clearance(_post())),
    "e11_work_mode": _select("postings", "pos", work_mode=lambda: wording.work_mode(F.concat_ws(" ", keys.text("place"), keys.text("summary")))),
    "e13_nationwide": e13_nationwide,
    "e26_title_relevance": _select("postings", "pos", relevance=lambda: F.round(wording.title_relevance("title", ["data", "software", "engineer", "developer", "analyst"]), 4)),
}

_WANTED = "['data', 'software', 'engine', 'develop', 'analyst']"
_BLOB = rf"regexp_replace(coalesce(salary, '') || ' ' || coalesce(summary, ''), '{wording.RETIREMENT}', ' ', 'g')"
# no look-behind here: the sign before an amount is taken along, and what follows it is left to the next
_AMOUNT = r"(^|[^\w.])\$?\s*(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)(?:\s*([kK])\b)?"
_TOK = _ordered_distinct(sql_tokens("title"))
_MODE = "lower(coalesce(place, '') || ' ' || coalesce(summary, ''))"
_CLEAR = f"lower({_POST})"

SQL = {
    "n01_normalize_company": f"select pos, {sql_company('company')} as company_key from postings",
    "n02_normalize_title": f"select pos, {sql_title('title')} as title_key from postings",
    "n03_canonical_url": f"select pos, {sql_url('url')} as url_key from postings",
    "n04_parse_date": f"select pos, {sql_date('posted')} as posted_on from postings",
    "n05_feed_date": r"""select pos, case when regexp_matches(trim(coalesce(posted, '')), '^\d{4}-\d{2}-\d{2}') then cast(try_strptime(left(trim(posted), 10), '%Y-%m-%d') as date)
        when regexp_full_match(trim(coalesce(posted, '')), '\d{1,2}/\d{1,2}/\d{4}') then cast(try_strptime(trim(posted), '%m/%d/%Y') as date) end as posted_on from postings""",
    "n10_posting_id": f"select pos, left(sha1(case when {sql_url('url')} <> '' then {sql_url('url')} else {sql_company('company')} || '|' || {sql_title('title')} end), 12) as id from postings",
    "n11_age_days": f"select pos, cast(date '{TODAY}' - {sql_date('posted')} as int) as age_days from postings",
    "n12_host_of": f"select pos, {sql_host('url')} as host from postings",
    "n13_host_matches": f"select pos, {sql_host('url')} = 'dayworks.example' or suffix({sql_host('url')}, '.dayworks.example') as on_board from postings",
    "n14_domain_of": f"""select pos, case when len(p) <= 2 then h when p[-2] in ('co', 'com', 'org', 'net', 'ac', 'gov', 'edu') and length(p[-1]) = 2 then array_to_string(p[-3:], '.')
        else array_to_string(p[-2:], '.') end as domain from (select pos, h, string_split(h, '.') as p from (select pos, {sql_host('url')} as h from postings))""",
    "n16_person_key": r"""select contact_id, case when t = '' then '' when regexp_extract(t, '/in/([^/?#]+)', 1) <> '' then 'in:' || regexp_extract(t, '/in/([^/?#]+)', 1)
        when contains(t, '@') then 'mail:' || t else 'name:' || regexp_replace(t, '\s+', ' ', 'g') end as person from (select contact_id, lower(trim(coalesce(full_name, ''))) as t from contacts)""",
    "n17_employer_key": f"select contact_id, case when {sql_company('company')} = '' then '' else 'co:' || {sql_company('company')} end as employer from contacts",
    "n18_board_slugs": r"""select application_id, array_to_string(list_filter(s, lambda x, i: length(x) > 1 and list_position(s, x) = i), ' ') as slugs from (
        select application_id, [array_to_string(w, ''), array_to_string(w, '-'), case when len(w) > 1 then w[1] else '' end] as s from (
        select application_id, list_filter(string_split_regex(lower(regexp_replace(coalesce(company, ''), '(?i)\b(inc|llc|ltd|limited|corp|corporation|co|company|plc|gmbh|sa|nv|bv|ag|pty|holdings)\b\.?', ' ', 'g')), '[^a-z0-9]+'), lambda x: x <> '') as w from applications))""",
    "n21_company_tokens": f"select pos, array_to_string(list_filter(string_split_regex(lower(coalesce(company, '')), '[^a-z0-9]+'), lambda w: length(w) > 2 and w not in ('the', 'inc', 'llc', 'ltd', 'corp', 'corporation', 'company', 'co', 'group', 'holdings', 'national', 'laboratory', 'laboratories', 'labs', 'lab', 'technologies', 'technology', 'systems', 'solutions', 'services', 'and', 'of', 'for', 'university', 'institute', 'center', 'centre')), ' ') as tokens from postings",
    "n22_title_tokens": f"select pos, array_to_string({_TOK}, ' ') as tokens from postings",
    "n24_title_fragments": rf"""select pos, array_to_string(list_filter(list_transform(string_split_regex(coalesce(title, ''), '[/,;&()]|\s[-–—]\s'), lambda p: array_to_string({_WORDS.format('p')}, ' ')), lambda p: p <> ''), '|') as fragments from postings""",
    "n29_message_domain": r"select row_no, lower(regexp_extract(coalesce(sender, ''), '@([\w.\-]+)', 1)) as domain from messages",
    "n30_counterpart": "select row_no, lower(trim(coalesce(case when from_me then recipient else sender end, ''))) as counterpart from messages",
    "n31_clean_subject": r"select row_no, trim(regexp_replace(coalesce(subject, ''), '(?i)^\s*((re|fwd?|message replied|new message)\s*:\s*)+', '')) as subject from messages",
    "n32_message_text": r"select row_no, concat_ws(chr(10), nullif(subject, ''), nullif(snippet, ''), nullif(body, '')) as text from messages",
    "n35_unwrap": r"select row_no, replace(regexp_replace(regexp_replace(regexp_replace(coalesce(body, ''), '(\n\n+)', chr(1) || '\1' || chr(1), 'g'), '([^\n\x01])\n([^\n\x01])', '\1 \2', 'g'), '([^\n\x01])\n([^\n\x01])', '\1 \2', 'g'), chr(1), '') as text from messages",
    "n41_contact_key": f"select contact_id, lower(trim(coalesce(full_name, ''))) || '|' || {sql_company('company')} as key from contacts",
    "n44_excerpt": "select doc_id, case when length(text) > 200 then left(text, 200) || ' [cut]' else coalesce(text, '') end as excerpt from documents",
    "n45_document_kind": r"""select doc_id, case when regexp_matches(f, 'resume|r.sum.|\bcv\b') then 'resume' when contains(f, 'cover') then 'cover_letter'
        when regexp_matches(f, 'job[^a-z0-9]*desc|posting|requisition|role') then 'job_description' when regexp_matches(f, 'recruiter|thread|email|interview|call|prep|screen|correspondence') then 'correspondence' else 'other' end as kind_of_name
        from (select doc_id, lower(regexp_extract(coalesce(path, ''), '([^/]*)$', 1)) as f from documents)""",
    "e01_salary": rf"""with b as (select pos, {_BLOB} as b from postings),
        v as (select pos, b, list_transform(list_zip(regexp_extract_all(b, '{_AMOUNT}', 2), regexp_extract_all(b, '{_AMOUNT}', 3)), lambda x: cast(replace(x[1], ',', '') as double) * case when x[2] <> '' then 1000 else 1 end) as v from b),
        y as (select pos, case when regexp_matches(b, '{wording.PAY_WORDS}') then list_filter(list_transform(v, lambda x: case when x >= 1000 then x when regexp_matches(b, '{wording.HOURLY}') then x * {wording.HOURS_A_YEAR} end), lambda x: x is not null and x <= 10000000) end as y from v)
        select pos, cast(round_even(list_min(y), 0) as int) as low, cast(round_even(list_max(y), 0) as int) as high from y""",
    "e02_employment_type": f"select pos, {_KINDS} as employment from postings",
    "e04_clearance": rf"""select pos, case when trim(b) = '' then null when regexp_matches(b, '(?i)clearance (?:is )?(?:not required|preferred but not|eligible)|ability to obtain (?:a |an )?clearance|clearance[- ]eligible') then false
        when regexp_matches(b, '(?i)active\s+(?:security\s+)?clearance|\b(?:ts/sci|top secret|secret clearance|q[\s-]clearance|l[\s-]clearance)\b|must (?:possess|hold|have)\s+(?:an?\s+)?active|current\s+(?:dod\s+)?(?:security\s+)?clearance') then true end as clearance
        from (select pos, {_POST} as b from postings)""",
    "e11_work_mode": f"select pos, case when {_says(_MODE, wording.HYBRID)} then 'hybrid' when {_says(_MODE, wording.REMOTE)} then 'remote' when trim({_MODE}) <> '' then 'onsite' else 'unknown' end as work_mode from postings",
    "e13_nationwide": f"""select pos, p in ('us', 'usa', 'u.s.', 'u.s.a.', 'united states', 'united states of america', 'us only', 'usa only', 'us-based', 'us based', 'anywhere', 'anywhere in the us', 'global', 'worldwide',
        'north america', 'continental us', 'lower 48', 'all 50 states', 'nationwide', 'remote us', 'us remote') or {_says('p', wording.NATIONWIDE)} as nationwide from (select pos, trim(lower(trim(coalesce(place, ''))), '.,;:-–()[] ') as p from postings)""",
    "e26_title_relevance": f"""select pos, round(case when len(t) = 0 then 0.0 else least(1.0, len(list_filter(t, lambda w: list_contains({_WANTED}, w))) / cast(least(len(t), 4) as double)) end, 4) as relevance
        from (select pos, {_TOK} as t from postings)""",
}
