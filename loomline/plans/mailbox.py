"""Queries over what mails say and over folds of a mailbox."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomline.functions import mail
from loomline.operators import mailbox
from loomline.plans.scalars import SQL as SCALAR, sql_company
from loomline.runtime import read_table


def _of_mail(**columns: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return read_table(spark, folder, "messages").select("row_no", *[c().alias(n) for n, c in columns.items()])

    return query


def _mail(fold: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: fold(read_table(spark, folder, "messages"))


def a07_employer_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return mailbox.employer_buckets(read_table(spark, folder, "messages"), read_table(spark, folder, "aliases"))


QUERIES = {
    "e03_employer": _of_mail(employer=mail.employer),
    "e05_tidy_company": lambda spark, folder: read_table(spark, folder, "postings").select("pos", mail.tidy_company(F.coalesce("company", F.lit(""))).alias("company")),
    "e06_person": _of_mail(person=mail.person),
    "e07_agency": _of_mail(agency=mail.agency),
    "e08_role": _of_mail(role=mail.role),
    "e09_mail_class": _of_mail(kind=mail.mail_class),
    "e10_system_kind": _of_mail(system=mail.system_kind),
    "e19_human": _of_mail(human=mail.is_human),
    "n37_employer_label": _of_mail(employer=mail.employer_label),
    "n38_bucket": _of_mail(bucket=mail.bucket),
    "a02_applications": _mail(mailbox.applications),
    "a03_approaches": _mail(mailbox.approaches),
    "a04_named_contacts": _mail(mailbox.named_contacts),
    "a05_correspondents": _mail(mailbox.mail_conversations),
    "a07_employer_buckets": a07_employer_buckets,
    "a09_conversations_by_name": _mail(lambda m: mailbox.by_name(mailbox.mail_conversations(m))),
    "j17_thread_company": _mail(lambda m: mailbox.thread_employers(mailbox.read_mail(m)).select("row_no", "company")),
}


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def _holds(x: str, parts) -> str:
    return "(" + " or ".join(f"contains({x}, {_q(p)})" for p in parts) + ")"


_DAY = r"""case
    when regexp_full_match(d, '\d{1,15}') then make_timestamp(cast(d as bigint) * 1000)
    when regexp_full_match(d, '\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\dZ?') then try_cast(replace(replace(d, 'T', ' '), 'Z', '') as timestamp)
    when regexp_full_match(d, '\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[+-]\d\d:\d\d') then cast(try_cast(d as timestamptz) at time zone 'UTC' as timestamp)
    when regexp_full_match(d, '\w{3}, \d\d \w{3} \d{4} \d\d:\d\d:\d\d [+-]\d{4}') then cast(try_strptime(d, '%a, %d %b %Y %H:%M:%S %z') at time zone 'UTC' as timestamp) end"""
_UNWRAPPED = SCALAR["n35_unwrap"].partition("select row_no, ")[2].rpartition(" as text")[0].replace("coalesce(body, '')", "said")
_SYSTEM = "case " + " ".join(f"when domain = '{h}' or suffix(domain, '.{h}') then '{k}'" for h, k in mail.APPLICANT_SYSTEMS.items()) + " else '' end"
_KIND = f"""case when {_holds('s', mail.ALERTS)} then 'alert' when regexp_matches(t, {_q(mail.REJECTED)}) then 'rejection' when regexp_matches(t, {_q(mail.INTERVIEW)}) then 'interview'
    when system <> '' and regexp_matches(t, {_q(mail.APPLIED)}) then 'application' when contains(s, 'inmail-hit-reply@') and not me then 'recruiter'
    when {_holds('s', mail.RELAYS)} and not me then case when regexp_matches(t, {_q(mail.PITCH)}) then 'recruiter' else 'other' end when system <> '' then 'application'
    when regexp_matches(t, {_q(mail.PITCH)}) and not me then 'recruiter' else 'other' end"""
_NAME = f"trim(regexp_replace(regexp_replace(trim(x, ' ' || chr(9) || chr(10) || ',.!-—'), '\\s+', ' ', 'g'), {_q(mail.CLAUSE)}, ''), ' ,.!-')"
_BARE = f"trim(regexp_replace({_NAME}, '(?i)^(?:the|a|an)\\s+', ''))"
_TIDY = f"case when length({_NAME}) < 2 or length({_NAME}) > 48 or lower({_BARE}) in {_in(mail.NO_NAMES)} or regexp_matches({_BARE}, {_q(mail.TITLE_LIKE)}) then '' else {_BARE} end"
_FIRST = "coalesce(list_filter({0}, lambda y: y <> '')[1], '')"
_EXTRACTS = lambda of, ps: "[" + ", ".join(f"regexp_extract({of}, {_q(p)}, 1)" for p in ps) + "]"
_LOCAL = f"regexp_replace(string_split(coalesce(sender, ''), '@')[1], {_q(mail.ROBOT_END)}, '')"
_CAPITALS = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_TENANT = f"case when system = 'tenant' and {_LOCAL} <> '' and not regexp_matches({_LOCAL}, {_q(mail.ROBOT)}) then {_CAPITALS.format(f'trim(translate({_LOCAL}, {chr(39)}_-{chr(39)}, {chr(39)}  {chr(39)}))')} else '' end"
_TITLE = "trim(regexp_replace(x, '\\s+', ' ', 'g'), ' -,|')"
_TITLED = f"case when length({_TITLE}) > 3 and length({_TITLE}) < 60 then {_TITLE} else '' end"
_PERSON = "case when lower(regexp_extract(p, '^(\\S+)', 1)) in " + _in(mail.NO_NAMES) + " or length(p) < 3 then '' else p end"
_SUBJECT = SCALAR["n31_clean_subject"].partition("select row_no, ")[2].rpartition(" as subject")[0]

_READ = f"""m0 as (select row_no, message_id, thread_id, trim(msg_date) as d, sender, recipient, subject, snippet, body, coalesce(from_me, false) as me, from_me, lower(coalesce(sender, '')) as s,
        concat_ws(chr(10), nullif(subject, ''), nullif(snippet, ''), nullif(body, '')) as t, lower(regexp_extract(coalesce(sender, ''), '@([\\w.\\-]+)', 1)) as domain,
        coalesce(nullif(body, ''), nullif(snippet, ''), '') as said, lower(trim(coalesce(case when from_me then recipient else sender end, ''))) as other from messages),
    m1 as (select *, {_SYSTEM} as system, {_UNWRAPPED} as prose, {_SUBJECT} as clean, {_DAY} as ts, regexp_extract(other, '@(.*)$', 1) as host from m0),
    m2 as (select *, {_KIND} as kind, coalesce(strftime(ts, '%Y-%m-%d'), '') as day, coalesce(nullif(thread_id, ''), message_id) as thread from m1),
    m3 as (select *, {_FIRST.format(f"list_concat(case when kind = 'recruiter' then list_transform({_EXTRACTS('prose', mail.HIRING)}, lambda x: {_TIDY}) else [] end, list_transform({_EXTRACTS('t', mail.COMPANIES)}, lambda x: {_TIDY}), [{_TENANT}])")} as employer,
        {_FIRST.format(f"list_transform({_EXTRACTS('prose', mail.AGENCIES)}, lambda x: {_TIDY})")} as agency,
        {_FIRST.format(f"list_concat(list_transform({_EXTRACTS('clean', mail.SUBJECT_ROLES)}, lambda x: {_TITLED}), list_filter(list_transform({_EXTRACTS('t', mail.TEXT_ROLES)}, lambda x: {_TITLED}), lambda r: regexp_matches(r, {_q(mail.TITLE_LIKE)})))")} as role,
        {_FIRST.format(f"list_transform(list_concat([trim(regexp_replace(trim(regexp_extract(coalesce(body, ''), {_q(mail.RELAY_HEADER)}, 1)), {_q(mail.CREDENTIAL)}, ''))], list_transform({_EXTRACTS('said', mail.PEOPLE)}, lambda x: trim(x))), lambda p: {_PERSON})")} as person from m2)"""
_HUMAN = f"case when not contains(other, '@') or regexp_matches(other, {_q(mail.NO_REPLY)}) then false when {_holds('other', mail.RELAYS)} then true when host in {_in(mail.CONSUMER_HOSTS)} then kind not in ('alert', 'other') else kind <> 'alert' end"
_LABEL = rf"""case when {_holds('other', mail.RELAYS)} then coalesce(nullif(employer, ''), agency) when host <> '' and host not in {_in(mail.CONSUMER_HOSTS)} and system = ''
    then replace(regexp_extract(regexp_replace(regexp_replace(host, '^(mail|email|careers|jobs|talent|hr)\.', ''), '\.(com|org|net|io|ai|co|gov|edu)(\.[a-z]{{2}})?$', ''), '([^.]*)$', 1), '-', ' ') else employer end"""
_BUCKET = f"case when {sql_company(_LABEL)} <> '' then {sql_company(_LABEL)} else 'thread:' || coalesce(nullif(thread_id, ''), nullif(message_id, ''), '') end"
_LOCAL_NAME = f"case when len(p) between 2 and 3 and len(list_filter(p, lambda x: not regexp_full_match(x, '[a-z]+'))) = 0 then {_CAPITALS.format("array_to_string(p, ' ')")} else '' end"
_CONVERSATIONS = f"""c as (select other as address, {_LOCAL_NAME} as name, me, day, clean from (select *, list_filter(string_split_regex(regexp_extract(other, '^([^@]+)@', 1), '[._-]'), lambda x: x <> '') as p from m2) where other <> ''),
    g as (select address, min(name) as name, count(*) filter (me) as sent, count(*) filter (not me) as received, coalesce(max(day) filter (me), '') as last_sent, coalesce(max(day) filter (not me), '') as last_received, count(distinct nullif(clean, '')) as subjects from c group by 1)"""
_ONLY = lambda column: f"with {_READ} select row_no, {column} from m3"

SQL = {
    "e03_employer": _ONLY("employer"),
    "e05_tidy_company": f"select pos, list_transform([coalesce(company, '')], lambda x: {_TIDY})[1] as company from postings",
    "e06_person": _ONLY("person"),
    "e07_agency": _ONLY("agency"),
    "e08_role": _ONLY("role"),
    "e09_mail_class": _ONLY("kind"),
    "e10_system_kind": _ONLY("system"),
    "e19_human": _ONLY(f"{_HUMAN} as human"),
    "n37_employer_label": _ONLY(f"{_LABEL} as employer"),
    "n38_bucket": _ONLY(f"{_BUCKET} as bucket"),
    "j17_thread_company": f"with {_READ} select row_no, coalesce(nullif(employer, ''), first_value(nullif(employer, '') ignore nulls) over (partition by thread order by ts nulls first, row_no rows between unbounded preceding and unbounded following), '') as company from m3 where thread is not null union all select row_no, employer from m3 where thread is null",
    "a02_applications": f"""with {_READ}, w as (select *, coalesce(nullif(employer, ''), case when thread is not null then first_value(nullif(employer, '') ignore nulls) over (partition by thread order by ts nulls first, row_no rows between unbounded preceding and unbounded following) end, '') as company from m3),
        k as (select *, {sql_company('company')} as company_key, row_number() over (order by ts nulls first, row_no) as o from w where company <> '' and kind in ('application', 'rejection', 'interview') and (system <> '' or kind = 'rejection'))
        select company_key, arg_min(company, o) as company, coalesce(arg_min(role, o) filter (role <> ''), '') as role, coalesce(min(day) filter (kind = 'application' and day <> ''), '') as applied, max(day) as last_heard,
        case when bool_or(kind = 'rejection') then 'rejected' when bool_or(kind = 'interview') then 'interviewed' else 'no answer' end as status, arg_min(domain, o) as ats, count(*) as n from k group by 1""",
    "a03_approaches": f"""with {_READ}, k as (select *, row_number() over (order by ts nulls first, row_no) as o, kind = 'recruiter' and not me as hit from m3 where thread is not null)
        select thread, coalesce(arg_min(person, o) filter (hit and person <> ''), '') as person, coalesce(arg_min(employer, o) filter (hit and employer <> ''), '') as company, coalesce(arg_min(agency, o) filter (hit and agency <> ''), '') as agency, arg_min(role, o) filter (hit) as role,
        arg_min(day, o) filter (hit) as first_contact, max(day) as last_contact, bool_or(me) or count(*) > 1 as replied, count(*) as messages, case when bool_or(kind = 'rejection') then 'closed' when bool_or(kind = 'interview') then 'spoke' else '' end as outcome
        from k group by thread having bool_or(hit)""",
    "a04_named_contacts": f"""with {_READ}, k as (select *, lower(person) as name_key, {sql_company('employer')} as company_key from m3 where not me and person <> '')
        select name_key, company_key, person as name, employer as company, case kind when 'recruiter' then 'approached' when 'interview' then 'interviewed' when 'rejection' then 'declined' else 'wrote' end as context, day as seen from k
        qualify row_number() over (partition by name_key, company_key order by day desc, row_no) = 1""",
    "a05_correspondents": f"with {_READ}, {_CONVERSATIONS} select * from g",
    "a09_conversations_by_name": f"with {_READ}, {_CONVERSATIONS} select 'name:' || lower(trim(name)) as key, name, sent, received, last_sent, last_received from g where name <> '' qualify row_number() over (partition by lower(trim(name)) order by address desc) = 1",
    "a07_employer_buckets": f"""with {_READ}, b as (select {_BUCKET} as b, nullif(day, '') as day from m3 where {_HUMAN}), a as (select {sql_company('spelling')} as b, min({sql_company('canonical')}) as to_ from aliases where {sql_company('spelling')} <> '' and {sql_company('canonical')} <> '' group by 1)
        select coalesce(to_, b) as bucket, cast(count(*) as bigint) as n, min(day) as first_on, max(day) as last_on from b left join a using (b) group by 1""",
}
