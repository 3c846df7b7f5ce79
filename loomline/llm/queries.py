"""Queries of the operators for training data, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm.authored import not_authored
from loomline.llm.conversations import clock_offsets, conversations
from loomline.llm.encoding import encode_corpus
from loomline.llm.leakage import leaked
from loomline.llm.linkage import repeated_postings
from loomline.llm.names import same_organisation
from loomline.llm.pii import lexicon, personal_places
from loomline.llm.spans import repeated_lines, shared_amounts, shared_stretches
from loomline.runtime import read_table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = not_authored(read_table(spark, folder, "messages"))
    return found.select("row_no", found["line_no"].cast("int").alias("line_no"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_postings(read_table(spark, folder, "postings"), read_table(spark, folder, "aliases"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    typed = [read_table(spark, folder, t) for t in ("postings", "applications", "contacts")]
    return same_organisation(typed, read_table(spark, folder, "aliases"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(read_table(spark, folder, "messages")).select("thread_id", "turn_no", "row_no")


def p5_clock_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return clock_offsets(read_table(spark, folder, "messages"))


def p5_corrected(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(read_table(spark, folder, "messages"), correct_clocks=True)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    mail, evidence = read_table(spark, folder, "messages"), read_table(spark, folder, "evidence")
    known = lexicon(read_table(spark, folder, "contacts").select("full_name"), evidence.select("who"))
    return personal_places(mail, "row_no", {"body": "body", "snippet": "snippet"}, known).unionAll(personal_places(evidence, "evidence_id", {"quote": "quote"}, known))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(read_table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_stretches(read_table(spark, folder, "documents"))


def p9_lines(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines(read_table(spark, folder, "documents"))


def p9_amounts(spark: SparkSession, folder: str) -> DataFrame:
    return shared_amounts(read_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p4_found, p5_found, p5_clock_offsets, p5_corrected, p6_found, p7_ids, p8_found, p9_found, p9_lines, p9_amounts)}

_BARE = r"nullif(regexp_replace({0}, '^[\s<>]+|[\s<>]+$', '', 'g'), '')"

SQL = {
    "p5_found": rf"""
        with m as (
          select row_no, {_BARE.format("message_id")} as id, {_BARE.format("thread_id")} as thread, trim(msg_date) as d, from_me,
            coalesce(trim(regexp_replace(body, '\s+', ' ', 'g')), '') <> '' or coalesce(trim(regexp_replace(snippet, '\s+', ' ', 'g')), '') <> '' as said
          from messages),
        f as (select * from m qualify id is null or row_number() over (partition by id order by row_no) = 1),
        t as (select *, case
            when regexp_full_match(d, '\d{{1,15}}') then make_timestamp(cast(d as bigint) * 1000)
            when regexp_full_match(d, '\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d:\d\dZ?') then try_cast(replace(replace(d, 'T', ' '), 'Z', '') as timestamp)
            when regexp_full_match(d, '\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d[+-]\d\d:\d\d') then cast(try_cast(d as timestamptz) at time zone 'UTC' as timestamp)
            when regexp_full_match(d, '\w{{3}}, \d\d \w{{3}} \d{{4}} \d\d:\d\d:\d\d [+-]\d{{4}}') then cast(try_strptime(d, '%a, %d %b %Y %H:%M:%S %z') at time zone 'UTC' as timestamp)
            end as ts from f where thread is not null),
        k as (select thread from t group by thread having count(ts) = count(*) and count(from_me) = count(*)
            and count(distinct case when said then from_me end) = 2)
        select thread as thread_id, cast(row_number() over (partition by thread order by ts, row_no) as int) as turn_no, row_no
        from t where said and thread in (select thread from k)""",
    "p8_found": r"""
        with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from documents where text is not null),
        g as (select doc_id, array_to_string(ws[i:i+11], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 10)) as i from w where len(ws) >= 12)),
        v as (select item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') as ws from eval_items where passage is not null),
        h as (select item_id, array_to_string(ws[i:i+11], ' ') as g from (select item_id, ws, unnest(range(1, len(ws) - 10)) as i from v where len(ws) >= 12))
        select distinct doc_id, item_id from g join h using (g)""",
    "p9_found": """
        with w as (select doc_id, text, unnest(range(1, length(text) - 254)) as i from documents where length(text) >= 256),
        h as (select doc_id, cast(i - 1 as int) as s, hash(substr(text, i, 256)) as h from w),
        k as (select h from h group by h having min(doc_id) < max(doc_id)),
        c as (select doc_id, s, case when s <= lag(s) over (partition by doc_id order by s) + 256 then 0 else 1 end as new from h where h in (select h from k)),
        g as (select doc_id, s, sum(new) over (partition by doc_id order by s) as g from c)
        select doc_id, cast(min(s) as int) as start_at, cast(max(s) + 256 as int) as end_at from g group by doc_id, g""",
    "p9_lines": r"""
        with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null and doc_id is not null),
        o as (select doc_id, line, cast(sum(length(line) + 1) over (partition by doc_id order by i) - length(line) - 1 as int) as s from l),
        u as (select doc_id, s, cast(s + length(line) as int) as e, lower(trim(regexp_replace(line, '[ \t\r\f\v]+', ' ', 'g'), ' ')) as u from o),
        f as (select *, first_value(doc_id) over w as fd, first_value(s) over w as fs from u where length(u) >= 40 window w as (partition by u order by doc_id, s))
        select doc_id, s as start_at, e as end_at, fd as first_doc, fs as first_at from f where doc_id <> fd or s <> fs""",
}
