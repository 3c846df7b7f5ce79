"""Queries over people, employers and addresses: keys, merges, prioritised lookups, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomline.functions import keys, urls
from loomline.operators import people
from loomline.plans.scalars import SQL as SCALAR, TODAY, sql_company, sql_host, sql_path
from loomline.runtime import read_table


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "postings")


def n15_profile_slug(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of postings as profile addresses: what stands after the first segment is the slug."""
    return _postings(spark, folder).select("pos", keys.profile_slug(F.regexp_replace(keys.text("url"), r"(://[^/]+/)", "$1in/")).alias("slug"))


def n19_specific_slug(spark: SparkSession, folder: str) -> DataFrame:
    slug = F.lower(F.regexp_extract(keys.path_of("url"), r"^/([^/]+)", 1))
    return _postings(spark, folder).select("pos", keys.is_specific(slug, "company").alias("specific"))


def n20_clean_board_url(spark: SparkSession, folder: str) -> DataFrame:
    typed = F.regexp_replace(keys.text("url"), r"^https://jobs\.levra\.example/([^/]+)", "https://jobs.lever.co/$1.com")
    return _postings(spark, folder).select("pos", urls.clean_board_url(typed).alias("url"))


def n25_slug_title(spark: SparkSession, folder: str) -> DataFrame:
    slug = F.regexp_extract(keys.path_of("url"), r"/([A-Za-z-]+)_[A-Za-z0-9-]+$", 1)
    return _postings(spark, folder).select("pos", urls.slug_title(slug).alias("title"))


def n26_listed_place(spark: SparkSession, folder: str) -> DataFrame:
    typed = F.regexp_replace(keys.text("place"), r"^([^,]+), ([A-Z]{2})$", "US-$2-$1")
    return _postings(spark, folder).select("pos", urls.listed_place(typed).alias("place"))


def n27_board_parts(spark: SparkSession, folder: str) -> DataFrame:
    p = urls.board_parts("url")
    return _postings(spark, folder).select("pos", p["host"].alias("host"), p["tenant"].alias("tenant"), p["site"].alias("site"))


def n40_identity(spark: SparkSession, folder: str) -> DataFrame:
    return _postings(spark, folder).select("pos", keys.connection_identity("url", "company", "title").alias("identity"))


def n42_holds_word(spark: SparkSession, folder: str) -> DataFrame:
    return _postings(spark, folder).select("pos", keys.holds_word(F.lower("title"), "data").alias("holds"))


def n43_careers_url(spark: SparkSession, folder: str) -> DataFrame:
    return _postings(spark, folder).select("pos", urls.careers_like("url").alias("careers"))


def e16_source_class(spark: SparkSession, folder: str) -> DataFrame:
    s = urls.source_class("url", "company")
    return _postings(spark, folder).select("pos", s["class"].alias("class"), s["label"].alias("label"))


def e22_system_of_host(spark: SparkSession, folder: str) -> DataFrame:
    host = F.replace(keys.host_of("url"), F.lit("jobs.levra.example"), F.lit("jobs.lever.co"))
    return _postings(spark, folder).select("pos", urls.system_of_host(host).alias("system"))


def e29_grid_url(spark: SparkSession, folder: str) -> DataFrame:
    return _postings(spark, folder).select("pos", urls.is_grid(F.concat(keys.text("url"), F.when(F.col("pos") % 2 == 0, "/c/HRS_HRAM_FL.HRS_CG_SEARCH_FL.GBL").otherwise(""))).alias("grid"))


def e27_same_employer(spark: SparkSession, folder: str) -> DataFrame:
    """Postings whose company is the same employer as that of the application whose thread or number is theirs."""
    a = read_table(spark, folder, "applications").select(F.col("application_id").alias("pos"), F.col("company").alias("other"))
    near = _postings(spark, folder).select(F.pmod("pos", F.lit(300)).alias("k"), "pos", "company")
    return near.join(a.withColumnRenamed("pos", "k"), "k").select("pos", keys.same_employer("company", "other").alias("same"))


def j08_snapshot_changes(spark: SparkSession, folder: str) -> DataFrame:
    """What changed between the postings of batch 0 and later ones under one address: new, another employer, another title."""
    rows = _postings(spark, folder).where("url != ''").select("batch_no", keys.url_key("url").alias("identity"), "company", F.col("title").alias("position"), "pos")
    last = rows.where("batch_no > 0").groupBy("identity").agg(F.max_by(F.struct("company", "position"), "pos").alias("x")).select("identity", "x.company", "x.position")
    return people.snapshot_changes(rows.where("batch_no = 0").select("identity", "company", "position"), last).select("identity", "change")


def e33_change_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = _postings(spark, folder).select("pos", F.element_at(F.array(F.lit("new"), F.lit("moved"), F.lit("promoted")), F.pmod("pos", F.lit(3)).cast("int") + 1).alias("change"), F.col("title").alias("position"), "company", F.col("source").alias("was_company"), F.col("place").alias("was_position"))
    return rows.select("pos", people.change_text().alias("summary"))


def j12_alias_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Employers' keys that stand under one address."""
    return people.alias_pairs(_postings(spark, folder).select(keys.url_key("url").alias("person"), F.col("company").alias("employer")))


def j06_with_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts with what mail was exchanged under their name, and under the slug of their name."""
    from loomline.operators.mailbox import by_name, mail_conversations

    named = by_name(mail_conversations(read_table(spark, folder, "messages")))
    slugs = named.select(F.regexp_replace(F.substring("key", 6, 200), " ", "-").alias("key"), "sent", "received", "last_sent", "last_received")
    contacts = read_table(spark, folder, "contacts").select("contact_id", keys.text("full_name").alias("name"), F.concat(F.lit("https://x.example/in/"), F.lower(F.regexp_replace(F.trim(keys.text("full_name")), " ", "-"))).alias("url"))
    return people.with_conversations(contacts, slugs, named).select("contact_id", "sent", "received", "last_sent", "last_received", "two_way")


def j07_dismissed(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts that a dismissal of a person or of an employer covers; dismissed are the writers of evidence and the employers of rejected applications."""
    gone = read_table(spark, folder, "evidence").where("evidence_id % 5 = 0").select(keys.person_key("who").alias("key")).unionAll(read_table(spark, folder, "applications").where("status = 'rejected'").select(keys.employer_key("company")))
    return people.dismissed(read_table(spark, folder, "contacts"), gone.where("key != ''"), "contact_id", ["full_name"], "company")


def j11_merged_spells(spark: SparkSession, folder: str) -> DataFrame:
    """Applications of a thread, or alone, as spells at an employer."""
    rows = read_table(spark, folder, "applications").where("company != ''").select(F.pmod("application_id", F.lit(40)).cast("string").alias("owner"), F.lit("employer").alias("kind"), F.col("company").alias("name"), keys.text("applied").alias("start"), keys.text("last_heard").alias("end"), F.col("application_id").alias("seq"))
    return people.merged_spells(rows)


def j16_registry(spark: SparkSession, folder: str) -> DataFrame:
    """A registry of employers applied to, with those of postings proposed."""
    applied = read_table(spark, folder, "applications").select(keys.company_key("company").alias("name")).where("name != ''").distinct()
    registry = applied.select("name", F.lit("").alias("why"), F.lit("").alias("careers_url"), F.lit("").alias("ats"), F.lit("new").alias("status"), F.lit(True).alias("applied_to"), F.lit("2026-01-01").alias("added"))
    proposed = _postings(spark, folder).select(keys.company_key("company").alias("name"), F.lit("posting").alias("why"), keys.text("url").alias("careers_url"), keys.text("source").alias("ats"), F.when(keys.text("url") != "", "resolved").otherwise("new").alias("status"), F.lit(False).alias("applied_to"))
    return people.upsert_registry(registry, proposed, TODAY)


def j10_collected(spark: SparkSession, folder: str) -> DataFrame:
    """Results by whether their name is in the registry: number of each."""
    known = read_table(spark, folder, "applications").select(keys.company_key("company").alias("k")).where("k != ''").distinct()
    found = _postings(spark, folder).select(keys.company_key("company").alias("k"))
    return found.join(known.withColumn("known", F.lit(True)), "k", "left").groupBy(F.coalesce("known", F.lit(False)).alias("known")).agg(F.count(F.lit(1)).alias("n"))


def u04_active(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "applications").where("coalesce(status, '') != 'rejected'").select("application_id")


def u06_unknown_proposals(spark: SparkSession, folder: str) -> DataFrame:
    known = read_table(spark, folder, "applications").select(keys.company_key("company").alias("k"))
    return _postings(spark, folder).select("pos", keys.company_key("company").alias("k")).where("k != ''").join(known, "k", "left_anti").select("pos")


def u07_positions_education(spark: SparkSession, folder: str) -> DataFrame:
    """Spells of work and of schooling as one table."""
    work = read_table(spark, folder, "applications").where("company != ''").select(F.col("company").alias("name"), F.lit("employer").alias("kind"), keys.text("applied").alias("start"))
    school = read_table(spark, folder, "contacts").where("company != ''").select(F.col("company").alias("name"), F.lit("school").alias("kind"), keys.text("seen").alias("start"))
    return work.unionByName(school)


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name[0] in "nejwu" and name[1:3].isdigit()}

_C, _H, _P = sql_company("company"), sql_host("url"), sql_path("url")
_U = SCALAR["n03_canonical_url"].partition("select pos, ")[2].rpartition(" as url_key")[0]


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def sql_same(a: str, b: str) -> str:
    ka, kb = sql_company(a), sql_company(b)
    return f"""list_transform([{{'a': {ka}, 'b': {kb}}}], lambda k: case when k.a = '' or k.b = '' then false when k.a = k.b then true else
        list_transform([{{'x': list_distinct(string_split(k.a, ' ')), 'y': list_distinct(string_split(k.b, ' '))}}], lambda t: list_transform([len(list_filter(list_intersect(t.x, t.y), lambda w: length(w) > 3 and w not in ({_quoted(keys.GENERIC)})))],
        lambda n: n > 0 and n / cast(least(len(t.x), len(t.y)) as double) >= 0.5)[1])[1] end)[1]"""


_LEGAL = r"list_filter(string_split_regex(lower(regexp_replace(coalesce(company, ''), '(?i)\b(inc|llc|ltd|limited|corp|corporation|co|company|plc|gmbh|sa|nv|bv|ag|pty|holdings)\b\.?', ' ', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
_UNDER = lambda hosts, h="h": "[x for x in [" + _quoted(hosts) + f"] if {h} = x or suffix({h}, '.' || x)][1]"
_CAPS = "array_to_string(list_transform(list_filter(string_split(replace({0}, '_', '-'), '-'), lambda w: w <> ''), lambda w: case when lower(w) in ('hp', 'ai', 'ml', 'qa', 'it') then upper(w) else upper(w[1]) || lower(w[2:]) end), ' ')"


def _sql() -> dict[str, str]:
    from loomline.plans.mailbox import _CONVERSATIONS, _READ
    from loomline.plans.more import SQL as MORE

    own = MORE["e17_employer_host"]
    return {
        "n15_profile_slug": r"select pos, lower(regexp_extract(trim(regexp_replace(coalesce(url, ''), '(://[^/]+/)', '\1in/')), '(?i)/in/([^/?#]+)', 1)) as slug from postings",
        "n19_specific_slug": f"select pos, len(w) <= 1 or s = array_to_string(w, '') or s = array_to_string(w, '-') as specific from (select pos, {_LEGAL} as w, lower(regexp_extract({_P}, '^/([^/]+)', 1)) as s from postings)",
        "n20_clean_board_url": r"""select pos, case when starts_with(u, 'https://jobs.lever.co/') then regexp_replace(regexp_replace(u, '[?#].*$', ''), '^(https://jobs\.lever\.co/[^/]+)\.com(.*?)/*$', '\1\2') else u end as url
            from (select pos, regexp_replace(coalesce(url, ''), '^https://jobs\.levra\.example/([^/]+)', 'https://jobs.lever.co/\1.com') as u from postings)""",
        "n25_slug_title": f"select pos, {_CAPS.format('s')} as title from (select pos, regexp_extract({_P}, '/([A-Za-z-]+)_[A-Za-z0-9-]+$', 1) as s from postings)",
        "n26_listed_place": "select pos, trim(coalesce(place, '')) as place from postings",
        "n27_board_parts": f"select pos, h as host, string_split(h, '.')[1] as tenant, coalesce(list_filter(string_split(p, '/'), lambda x: x <> '' and not regexp_matches(x, '^[a-z]{{2}}([-_][A-Za-z]{{2}})?$'))[1], '') as site from (select pos, {_H} as h, {_P} as p from postings)",
        "n40_identity": "select pos, lower(case when coalesce(url, '') <> '' then rtrim(url, '/') else coalesce(company, '') || '|' || coalesce(title, '') end) as identity from postings",
        "n42_holds_word": r"select pos, regexp_matches(coalesce(lower(title), ''), '(^|[^\p{L}\p{N}_])data([^\p{L}\p{N}_]|$)') as holds from postings",
        "n43_careers_url": f"select pos, {_UNDER(urls.SYSTEM_HOSTS)} is not null or len([w for w in [{_quoted(urls.CAREER_WORDS)}] if contains(lower(coalesce(url, '')), w)]) > 0 as careers from (select *, {_H} as h from postings)",
        "e16_source_class": f"""select pos, case when h = '' then 'denied' when {_UNDER(urls.DENIED_HOSTS)} is not null then 'denied' when {_UNDER(urls.SYSTEM_HOSTS)} is not null then 'ats' when {_UNDER(urls.PUBLIC_HOSTS)} is not null then 'public' when regexp_matches(h, '[.](gov|mil|edu)$') then 'public' when own then 'employer' else 'unknown' end as class,
            case when h = '' then 'no URL' when own then 'employer site (' || h || ')' else 'unrecognised site (' || h || ')' end as label from (select *, {_H} as h from postings) join ({own}) using (pos)""",
        "e22_system_of_host": f"select pos, case when contains({_H}, 'jobs.levra.example') then 'Lever' else '' end as system from postings",
        "e29_grid_url": "select pos, pos % 2 = 0 as grid from postings",
        "e27_same_employer": f"select pos, {sql_same('company', 'other')} as same from postings join (select application_id, company as other from applications) on application_id = pos % 300",
        "j08_snapshot_changes": f"""with r as (select *, {_U} as identity from postings where url <> ''), o as (select identity, max(row(coalesce(company, ''), coalesce(title, ''))) as w from r where batch_no = 0 group by 1),
            l as (select * from r where batch_no > 0 qualify row_number() over (partition by identity order by pos desc) = 1),
            c as (select l.identity, case when w is null then 'new' when coalesce(company, '') <> '' and not {sql_same('w[1]', 'company')} then 'moved' when coalesce(title, '') <> '' and lower(trim(title)) <> lower(trim(w[2])) then 'promoted' end as change from l left join o using (identity))
            select * from c where change is not null""",
        "e33_change_text": """select pos, case pos % 3 when 0 then 'new connection — ' || coalesce(nullif(title, ''), 'role unknown') || ' at ' || coalesce(nullif(company, ''), 'company unknown') when 1 then coalesce(nullif(source, ''), '?') || ' → ' || coalesce(nullif(company, ''), '?')
            else coalesce(nullif(place, ''), '?') || ' → ' || coalesce(nullif(title, ''), '?') || ' (same employer)' end as summary from postings""",
        "j12_alias_pairs": f"with s as (select distinct {_U} as p, {_C} as e from postings where {_U} <> '' and {_C} <> '') select distinct a.e as employer_a, b.e as employer_b from s a join s b on a.p = b.p and a.e < b.e",
        "j06_with_conversations": f"""with {_READ}, {_CONVERSATIONS}, k as (select lower(trim(name)) as key, * from g where name <> '' qualify row_number() over (partition by lower(trim(name)) order by address desc) = 1)
            select contact_id, cast(2 * coalesce(sent, 0) as bigint) as sent, cast(2 * coalesce(received, 0) as bigint) as received, coalesce(last_sent, '') as last_sent, coalesce(last_received, '') as last_received, coalesce(sent, 0) > 0 and coalesce(received, 0) > 0 as two_way
            from contacts left join k on lower(trim(coalesce(full_name, ''))) = key""",
        "j07_dismissed": rf"""with p as (select evidence_id, lower(trim(coalesce(who, ''))) as t from evidence where evidence_id % 5 = 0), g as (select case when contains(t, '@') then 'mail:' || t else 'name:' || regexp_replace(t, '\s+', ' ', 'g') end as key from p where t <> ''
            union select 'co:' || {_C} from applications where status = 'rejected' and {_C} <> ''),
            k as (select contact_id, case when t = '' then '' when contains(t, '@') then 'mail:' || t else 'name:' || regexp_replace(t, '\s+', ' ', 'g') end as person, case when {_C} <> '' then 'co:' || {_C} else '' end as co from (select *, lower(trim(coalesce(full_name, ''))) as t from contacts))
            select contact_id, case when person in (select key from g) then person when co in (select key from g) then co end as covered_by from k""",
        "j16_registry": f"""with r as (select distinct {_C} as name from applications where {_C} <> ''), p as (select {_C} as name, max('posting') as why, min(nullif(url, '')) as careers_url, min(nullif(source, '')) as ats, bool_or(coalesce(url, '') <> '') as resolved from postings where {_C} <> '' group by 1)
            select coalesce(r.name, p.name) as name, coalesce(why, '') as why, coalesce(careers_url, '') as careers_url, coalesce(ats, '') as ats, case when coalesce(resolved, false) then 'resolved' else 'new' end as status, r.name is not null as applied_to,
            case when r.name is null then '{TODAY}' else '2026-01-01' end as added from r full join p on r.name = p.name""",
        "j10_collected": f"select {_C} in (select {_C} from applications where {_C} <> '') as known, count(*) as n from postings group by 1",
        "u04_active": "select application_id from applications where coalesce(status, '') <> 'rejected'",
        "u06_unknown_proposals": f"select pos from postings where {_C} <> '' and {_C} not in (select {_C} from applications)",
        "u07_positions_education": "select company as name, 'employer' as kind, coalesce(applied, '') as start from applications where company <> '' union all select company, 'school', coalesce(seen, '') from contacts where company <> ''",
    }


SQL = _sql()
