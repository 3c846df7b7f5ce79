"""Further queries: quoted text, places, addresses of people, prioritised and interval joins, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomline.functions import dates, keys, scores, wording
from loomline.functions.quotes import FENCES, fences, without_quotes
from loomline.operators import records
from loomline.operators.intervals import best_interval
from loomline.plans.relations import _SCORED
from loomline.plans.scalars import SQL as SCALAR, TODAY, sql_company, sql_date, sql_host, sql_title, sql_tokens
from loomline.runtime import read_table

_today = lambda: F.lit(TODAY).cast("date")


def n06_relative_date(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("pos")
    said = F.when(n % 7 == 0, "Posted Today").when(n % 7 == 1, "Posted Yesterday").when(n % 7 == 2, "recently").otherwise(F.concat(F.lit("Posted "), (n % 40).cast("string"), F.when(n % 2 == 0, "+").otherwise(""), F.when(n % 3 == 0, " Weeks Ago").when(n % 3 == 1, " Days Ago").otherwise(" months ago")))
    return read_table(spark, folder, "postings").select("pos", dates.relative_date(said, _today()).alias("posted_on"))


def n09_path_segment(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.filter(F.split(keys.path_of("url"), "/"), lambda x: x != "")
    return read_table(spark, folder, "postings").select("pos", F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("slug"))


def n23_stem(spark: SparkSession, folder: str) -> DataFrame:
    words = read_table(spark, folder, "postings").select(F.explode(F.split(F.lower(keys.text("title")), "[^a-z]+")).alias("word")).where("word != ''").distinct()
    return words.select("word", wording.stem(F.col("word")).alias("stem"))


def n33_company_of_domain(spark: SparkSession, folder: str) -> DataFrame:
    domain = F.lower(F.regexp_extract(F.coalesce("sender", F.lit("")), r"@([\w.\-]+)", 1))
    label = F.regexp_extract(domain, r"([a-z0-9-]+)\.[a-z0-9-]+$", 1)
    return read_table(spark, folder, "messages").select("row_no", F.initcap(F.replace(label, F.lit("-"), F.lit(" "))).alias("company"))


def n34_name_of_address(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.filter(F.split(F.regexp_extract(F.lower(F.coalesce("sender", F.lit(""))), r"^([^@]+)@", 1), "[._-]"), lambda x: x != "")
    whole = F.size(parts).between(2, 3) & F.forall(parts, lambda x: x.rlike("^[a-z]+$"))
    return read_table(spark, folder, "messages").select("row_no", F.when(whole, F.initcap(F.array_join(parts, " "))).otherwise("").alias("name"))


def n36_strip_quoted(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "messages").select("row_no", without_quotes("body").alias("text"))


def n46_addresses(spark: SparkSession, folder: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower(F.coalesce("body", F.lit(""))), F.lit(r"[a-z0-9._+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+"), F.lit(0))
    return read_table(spark, folder, "messages").select("row_no", F.array_join(F.array_sort(F.array_distinct(found)), " ").alias("addresses"))


def e12_remote_fences(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "postings").select("pos", F.array_join(fences(F.concat_ws(". ", keys.text("place"), keys.text("summary"))), "|").alias("fences"))


def e17_employer_host(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "postings").select("pos", keys.is_employer_host(keys.host_of("url"), "company").alias("own"))


def e28_term_overlap(spark: SparkSession, folder: str) -> DataFrame:
    wanted = F.array(*[F.lit(x) for x in ("data", "software", "platform", "research", "security")])
    return read_table(spark, folder, "postings").select("pos", F.array_join(F.array_sort(F.array_intersect(F.split(F.lower(keys.text("title")), "[^a-z0-9]+"), wanted)), " ").alias("terms"))


def j01_prioritised_match(spark: SparkSession, folder: str) -> DataFrame:
    """Later postings with the earliest one of batch 0 under the first key that matches: address, then company and title."""
    rows = read_table(spark, folder, "postings").select("pos", "batch_no", keys.url_key("url").alias("u"), keys.company_key("company").alias("c"), keys.title_key("title").alias("t"))
    old = rows.where("batch_no = 0")
    by_url = old.where("u != ''").groupBy("u").agg(F.min("pos").alias("m_url"))
    by_pair = old.where("c != '' and t != ''").groupBy("c", "t").agg(F.min("pos").alias("m_pair"))
    return rows.where("batch_no > 0").join(by_url, "u", "left").join(by_pair, ["c", "t"], "left").select("pos", F.coalesce("m_url", "m_pair").alias("match"))


def j05_interval_join(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts with the application at their employer whose span, ninety days wider on each side, holds the day they were seen; the shortest span wins."""
    people = read_table(spark, folder, "contacts").select("contact_id", keys.company_key("company").alias("k"), dates.written_date("seen").alias("day")).where("k != '' and day is not null")
    spells = read_table(spark, folder, "applications").select("application_id", keys.company_key("company").alias("k"), dates.written_date("applied").alias("start"), dates.written_date("last_heard").alias("end"))
    return best_interval(people, spells, "contact_id", "day", "application_id", "start", "end", "k", slack=400).select("contact_id", "application_id")


def j13_host_class(spark: SparkSession, folder: str) -> DataFrame:
    """Class of each posting's host by its longest known suffix, looked up in a table of fixed size."""
    known = spark.createDataFrame([("dayworks.example", "board"), ("greenstem.example", "board"), ("levra.example", "board"), ("indexly.example", "aggregator"), ("www.indexly.example", "aggregator"), ("ashbrook.example", "board")], "suffix string, class string")
    rows = read_table(spark, folder, "postings").select("pos", keys.host_of("url").alias("host"))
    labels = F.split("host", r"\.")
    suffixes = rows.select("pos", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    best = suffixes.join(F.broadcast(known), "suffix").groupBy("pos").agg(F.max_by("class", F.length("suffix")).alias("class"))
    return rows.join(best, "pos", "left").select("pos", F.coalesce("class", F.lit("unknown")).alias("class"))


def a11_search_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Last words of title fragments by number, the forty most frequent; the limit is the feature."""
    last = read_table(spark, folder, "postings").select(F.explode(wording.title_fragments("title")).alias("f")).select(F.regexp_extract("f", r"(\S+)$", 1).alias("term")).where(F.length("term") >= 4)
    return last.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(40)


def a17_per_day(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "messages").groupBy(F.to_date("received_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("body", F.lit("")))).alias("chars"))


def a18_baseline(spark: SparkSession, folder: str) -> DataFrame:
    rows = records.scored(read_table(spark, folder, "postings"), TODAY).select("pos", "batch_no", "composite", keys.posting_id("url", "company", "title").alias("id"))
    return rows.where("batch_no = 0 and composite > 0").join(rows.where("batch_no > 0").select("id"), "id", "left_anti").select("pos", "composite")


def a19_silent_employers(spark: SparkSession, folder: str) -> DataFrame:
    asked = read_table(spark, folder, "applications").select(keys.company_key("company").alias("k")).where("k != ''").distinct()
    return asked.join(read_table(spark, folder, "postings").select(keys.company_key("company").alias("k")), "k", "left_anti").select(F.col("k").alias("company_key"))


def w01_recency(spark: SparkSession, folder: str) -> DataFrame:
    age = F.datediff(_today(), dates.written_date("posted"))
    return read_table(spark, folder, "postings").select("pos", F.round(scores.recency(age), 6).alias("recency"))


def w05_scored_order(spark: SparkSession, folder: str) -> DataFrame:
    """All postings best first: one sort by ranges, no task with all rows."""
    rows = records.scored(read_table(spark, folder, "postings"), TODAY)
    return rows.orderBy(F.desc("composite"), F.lower(keys.text("company")), "pos").select("pos", "composite")


def l10_latest_applications(spark: SparkSession, folder: str) -> DataFrame:
    """The forty applications last heard of; the limit is the feature."""
    rows = read_table(spark, folder, "applications").select("application_id", F.coalesce(dates.written_date("last_heard"), dates.written_date("applied")).alias("last_on"))
    return rows.orderBy(F.desc_nulls_last("last_on"), "application_id").limit(40)


def u08_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Every posting in exactly one of kept, duplicate and undated."""
    rows = read_table(spark, folder, "postings").select("pos", "posted", keys.posting_id("url", "company", "title").alias("id"), keys.company_key("company").alias("c"), keys.title_key("title").alias("t"))
    kept = records.deduplicated(rows, "id", ["c", "t"], "pos")
    dated = dates.written_date("posted")
    parts = kept.where(dated.isNotNull()).select("pos", F.lit("kept").alias("part")).unionByName(kept.where(dated.isNull()).select("pos", F.lit("undated").alias("part")))
    return parts.unionByName(rows.join(kept.select("pos"), "pos", "left_anti").select("pos", F.lit("duplicate").alias("part")))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name[0] in "nejawlu" and name[1:3].isdigit()}

_ID = SCALAR["n10_posting_id"].partition("select pos, ")[2].rpartition(" as id")[0]
_U = SCALAR["n03_canonical_url"].partition("select pos, ")[2].rpartition(" as url_key")[0]
_C, _T = sql_company("company"), sql_title("title")
_FRAGMENTS = SCALAR["n24_title_fragments"].partition("array_to_string(")[2].rpartition(", '|')")[0]
_DOMAIN = r"lower(regexp_extract(coalesce(sender, ''), '@([\w.\-]+)', 1))"
_CAP = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_SAID = "case when pos % 7 = 0 then 0 when pos % 7 = 1 then 1 when pos % 7 = 2 then null else (pos % 40) * (case pos % 3 when 0 then 7 when 1 then 1 else 30 end) + (case when pos % 2 = 0 then 1 else 0 end) end"
_BLOB = "coalesce(place, '') || '. ' || coalesce(summary, '')"

SQL = {
    "n06_relative_date": f"select pos, date '{TODAY}' - cast({_SAID} as int) as posted_on from postings",
    "n09_path_segment": f"select pos, coalesce(list_filter(string_split({SCALAR['n03_canonical_url'].partition('contains(')[2].partition(', ' + chr(39) + '/job/')[0]}, '/'), lambda x: x <> '')[1], '') as slug from postings",
    "n23_stem": r"select distinct w as word, regexp_replace(w, '^(.{4,}?)(?:ing|ers|er|s)+$', '\1') as stem from (select unnest(string_split_regex(lower(coalesce(title, '')), '[^a-z]+')) as w from postings) where w <> ''",
    "n33_company_of_domain": f"select row_no, {_CAP.format(f"replace(regexp_extract({_DOMAIN}, '([a-z0-9-]+)[.][a-z0-9-]+$', 1), '-', ' ')")} as company from messages",
    "n34_name_of_address": f"""select row_no, case when len(p) between 2 and 3 and len(list_filter(p, lambda x: not regexp_full_match(x, '[a-z]+'))) = 0 then {_CAP.format("array_to_string(p, ' ')")} else '' end as name
        from (select row_no, list_filter(string_split_regex(regexp_extract(lower(coalesce(sender, '')), '^([^@]+)@', 1), '[._-]'), lambda x: x <> '') as p from messages)""",
    "n36_strip_quoted": r"""with c as (select row_no, coalesce(body, '') as b from messages), d as (select row_no, b, list_min([case when m = '' then length(b) else strpos(b, m) - 1 end for m in [
        regexp_extract(b, '(?im)^\s*On .{0,120}\bwrote:\s*$'), regexp_extract(b, '(?im)^\s*-{2,}\s*Original Message\s*-{2,}\s*$'), regexp_extract(b, '(?m)^\s*_{10,}\s*$'), regexp_extract(b, '(?im)^\s*From:\s.+\nSent:\s.+$')]]) as n from c)
        select row_no, trim(regexp_replace(regexp_replace(array_to_string(list_filter(string_split_regex(left(b, n), '\r\n|\r|\n'), lambda l: not starts_with(ltrim(l), '>')), chr(10)), '(?is)\n\s*(--\s*\n.*|Sent from my \w+.*|This email was intended for.*|Unsubscribe:.*|You are receiving.*)$', ''), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) as text from d""",
    "n46_addresses": r"select row_no, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(body, '')), '[a-z0-9._+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+'))), ' '), '') as addresses from messages",
    "e12_remote_fences": f"""with b as (select pos, {_BLOB} as b from postings), f as (select pos, {" || ".join(f"regexp_extract_all(b, '{p}', 1)" for p in FENCES)} as f from b),
        g as (select pos, list_filter(list_transform(f, lambda x: trim(lower(trim(x)), '-–—:,; ')), lambda x: x <> '' and len(string_split_regex(x, '\\s+')) <= 8) as g from f)
        select pos, array_to_string(list_filter(g, lambda x, i: list_position(g, x) = i), '|') as fences from g""",
    "e17_employer_host": f"""with p as (select pos, company, h, string_split(h, '.') as l from (select pos, company, {sql_host('url')} as h from postings)),
        q as (select p.pos, h, l, regexp_replace(case when len(l) > 2 then array_to_string(l[-3:], '.') else h end, '[^a-z0-9]', '', 'g') as flat, string_split(t.tokens, ' ') as tokens,
            array_to_string(list_transform(list_filter(string_split_regex(lower(coalesce(company, '')), '[^a-z0-9]+'), lambda w: w not in ('', 'the', 'of', 'and', 'for', 'a')), lambda w: w[1]), '') as acronym
            from p join ({SCALAR['n21_company_tokens']}) t on t.pos = p.pos)
        select pos, h <> '' and len(list_filter(tokens, lambda x: x <> '')) > 0 and (len(list_filter(tokens, lambda x: x <> '' and contains(flat, x))) > 0 or (length(acronym) >= 3 and list_contains(l, acronym))) as own from q""",
    "e28_term_overlap": "select pos, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce(title, '')), '[^a-z0-9]+'), lambda w: w in ('data', 'software', 'platform', 'research', 'security')))), ' ') as terms from postings",
    "j01_prioritised_match": f"""with r as (select pos, batch_no, {_U} as u, {_C} as c, {_T} as t from postings)
        select pos, coalesce((select min(o.pos) from r o where o.batch_no = 0 and o.u <> '' and o.u = n.u), (select min(o.pos) from r o where o.batch_no = 0 and o.c <> '' and o.t <> '' and o.c = n.c and o.t = n.t)) as match from r n where batch_no > 0""",
    "j05_interval_join": f"""select contact_id, application_id from (select contact_id, application_id, row_number() over (partition by contact_id order by coalesce(e, date '9999-12-31') - s, s, application_id) as r
        from (select contact_id, {_C} as k, {sql_date('seen')} as d from contacts) join (select application_id, {_C} as k, {sql_date('applied')} as s, {sql_date('last_heard')} as e from applications) using (k)
        where k <> '' and d >= s - 400 and d <= coalesce(e, date '9999-12-31' - 400) + 400) where r = 1""",
    "j13_host_class": f"""select pos, case when h = 'indexly.example' or suffix(h, '.indexly.example') then 'aggregator' when regexp_matches(h, '(^|[.])(dayworks|greenstem|levra|ashbrook)[.]example$') then 'board' else 'unknown' end as class from (select pos, {sql_host('url')} as h from postings)""",
    "a11_search_terms": f"select term, count(*) as n from (select regexp_extract(f, '([^ ]+)$', 1) as term from (select unnest({_FRAGMENTS}) as f from postings)) where length(term) >= 4 group by term order by n desc, term limit 40",
    "a17_per_day": "select cast(received_at as date) as day, count(*) as n, cast(sum(length(coalesce(body, ''))) as bigint) as chars from messages group by 1",
    "a18_baseline": f"with p as (select pos, batch_no, composite, {_ID} as id from {_SCORED}) select pos, composite from p where batch_no = 0 and composite > 0 and id not in (select id from p where batch_no > 0)",
    "a19_silent_employers": f"select distinct {_C} as company_key from applications where {_C} <> '' and {_C} not in (select {_C} from postings)",
    "w01_recency": f"select pos, round(r, 6) as recency from {_SCORED}",
    "w05_scored_order": f"select pos, composite from {_SCORED} order by composite desc, lower(coalesce(company, '')), pos",
    "l10_latest_applications": f"select application_id, coalesce({sql_date('last_heard')}, {sql_date('applied')}) as last_on from applications order by last_on desc nulls last, application_id limit 40",
}
