"""Folds over a mailbox: applications, approaches, contacts, threads and employers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomline.functions import mail
from loomline.functions.instants import mail_instant
from loomline.functions.keys import company_key, text
from loomline.operators.skew import join_key_facts
from loomline.runtime import cut


def read_mail(messages: DataFrame) -> DataFrame:
    """What the folds need of each mail: row_no, thread, day, order, from_me, kind, system, domain, employer, person, agency, role.

    ``day`` is the UTC day of the written date or "" where none can be read;
    ``order`` sorts a thread by instant, unreadable ones first, then row_no.
    Each mail is read once; the texts do not go on.
    """
    at = mail_instant("msg_date")
    rows = messages.withColumn("ll_kind", mail.mail_class())
    kind = F.col("ll_kind")
    return rows.select(
        "row_no", F.coalesce(F.nullif("thread_id", F.lit("")), "message_id").alias("thread"), F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit("")).alias("day"),
        F.struct(F.coalesce(F.unix_micros(at), F.lit(-(2**62))).alias("at"), "row_no").alias("order"), F.coalesce("from_me", F.lit(False)).alias("from_me"), kind.alias("kind"), mail.system_kind().alias("system"),
        mail.sender_domain().alias("domain"), mail.employer(kind).alias("employer"), mail.person().alias("person"), mail.agency().alias("agency"), mail.role().alias("role"),
    )


def first_told(column: str, order: str = "order", where: str = "true"):
    """The first value of a column, by an order, that is not empty."""
    told = F.expr(where) & (F.col(column) != "")
    return F.coalesce(F.min_by(F.when(told, F.col(column)), F.when(told, F.col(order))), F.lit(""))


def thread_employers(read: DataFrame) -> DataFrame:
    """Mails with the employer that they, or else the first mail of their thread that tells one, name (``company``)."""
    facts = read.groupBy("thread").agg(first_told("employer").alias("told"), F.count(F.lit(1)).alias("ll_n"))
    named = join_key_facts(read.where("thread is not null"), facts, "thread", "ll_n").drop("ll_n").unionByName(read.where("thread is null").withColumn("told", F.lit("")))
    return named.withColumn("company", F.coalesce(F.nullif("employer", F.lit("")), "told")).drop("told")


def applications(messages: DataFrame) -> DataFrame:
    """Employers applied to: company_key, company, role, applied, last_heard, status, ats, n.

    Receipts, rejections and invitations count, the first and last only from
    applicant systems.  The employer is the mail's own or its thread's;
    mails of all threads meet under its key.  Applied is the first day of a
    receipt, last heard the last day of any, the role the first told; a
    rejection outranks an invitation, and that silence.  Days that cannot be
    read count for neither date.
    """
    rows = thread_employers(cut(read_mail(messages))).where("kind in ('application', 'rejection', 'interview') and (system != '' or kind = 'rejection')")
    rows = rows.withColumn("company_key", company_key("company")).where("company != ''")
    return rows.groupBy("company_key").agg(
        F.min_by("company", "order").alias("company"), first_told("role").alias("role"), F.coalesce(F.min(F.when((F.col("kind") == "application") & (F.col("day") != ""), F.col("day"))), F.lit("")).alias("applied"),
        F.max("day").alias("last_heard"), F.when(F.bool_or(F.col("kind") == "rejection"), "rejected").when(F.bool_or(F.col("kind") == "interview"), "interviewed").otherwise("no answer").alias("status"),
        F.min_by("domain", "order").alias("ats"), F.count(F.lit(1)).alias("n"),
    )


def approaches(messages: DataFrame) -> DataFrame:
    """Threads in which somebody offers work: thread, person, company, agency, role, first_contact, last_contact, replied, messages, outcome.

    Person, employer and agency are the first that an approach of the thread
    tells, the role is the first approach's; the thread is closed if any of
    its mails rejects, else spoke if any invites.
    """
    rows = cut(read_mail(messages)).where("thread is not null")
    hit = "kind = 'recruiter' and not from_me"
    folded = rows.groupBy("thread").agg(
        F.count_if(F.expr(hit)).alias("hits"), *[first_told(c, where=hit).alias(c) for c in ("person", "employer", "agency")], F.min_by(F.when(F.expr(hit), F.col("role")), F.when(F.expr(hit), F.col("order"))).alias("role"),
        F.min_by(F.when(F.expr(hit), F.col("day")), F.when(F.expr(hit), F.col("order"))).alias("first_contact"), F.max("day").alias("last_contact"), (F.bool_or("from_me") | (F.count(F.lit(1)) > 1)).alias("replied"), F.count(F.lit(1)).alias("messages"),
        F.when(F.bool_or(F.col("kind") == "rejection"), "closed").when(F.bool_or(F.col("kind") == "interview"), "spoke").otherwise("").alias("outcome"),
    )
    return folded.where("hits > 0").drop("hits").withColumnRenamed("employer", "company")


def named_contacts(messages: DataFrame) -> DataFrame:
    """People that mails name, one row per name and employer key: the latest seen, of equal days the earlier mail."""
    rows = cut(read_mail(messages)).where("not from_me and person != ''").withColumn("company_key", company_key("employer")).withColumn("name_key", F.lower("person"))
    context = F.when(F.col("kind") == "recruiter", "approached").when(F.col("kind") == "interview", "interviewed").when(F.col("kind") == "rejection", "declined").otherwise("wrote")
    best = rows.groupBy("name_key", "company_key").agg(F.max_by(F.struct(F.col("person").alias("name"), F.col("employer").alias("company"), context.alias("context"), F.col("day").alias("seen")), F.struct("day", -F.col("row_no"))).alias("c"))
    return best.select("name_key", "company_key", "c.name", "c.company", "c.context", "c.seen")


def employer_buckets(messages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Mail that people wrote, by employer or else by thread: bucket, n, first_on, last_on; other names of an employer are folded in by ``aliases``."""
    rows = messages.withColumn("ll_kind", mail.mail_class())
    kind = F.col("ll_kind")
    rows = rows.where(mail.is_human(kind)).select(mail.bucket(kind).alias("bucket"), F.date_format(mail_instant("msg_date"), "yyyy-MM-dd").alias("day"))
    if aliases is not None:
        # a name folds to one canonical name, the smallest where several were entered
        known = aliases.select(company_key("spelling").alias("bucket"), company_key("canonical").alias("to")).where("bucket != '' and to != ''").groupBy("bucket").agg(F.min("to").alias("to"))
        folded = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_on"), F.max("day").alias("last_on")).join(known, "bucket", "left")
        return folded.groupBy(F.coalesce("to", "bucket").alias("bucket")).agg(F.sum("n").alias("n"), F.min("first_on").alias("first_on"), F.max("last_on").alias("last_on"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_on"), F.max("day").alias("last_on"))


def mail_conversations(messages: DataFrame) -> DataFrame:
    """Per counterpart address: sent, received, last of each day, name read from the address, distinct subjects in the order in which they first came."""
    from loomline.functions.wording import clean_subject

    other, local = mail.counterpart(), F.regexp_extract(mail.counterpart(), r"^([^@]+)@", 1)
    parts = F.filter(F.split(local, "[._-]"), lambda x: x != "")
    named = F.when(F.size(parts).between(2, 3) & F.forall(parts, lambda x: x.rlike("^[a-z]+$")), F.initcap(F.array_join(parts, " "))).otherwise("")
    day = F.coalesce(F.date_format(mail_instant("msg_date"), "yyyy-MM-dd"), F.lit(""))
    rows = messages.select(other.alias("address"), named.alias("name"), F.coalesce("from_me", F.lit(False)).alias("me"), day.alias("day"), clean_subject("subject").alias("subject"), "row_no").where("address != ''")
    # subjects are made distinct before they are listed, so a list holds no more than the distinct ones
    per = rows.groupBy("address", "subject").agg(
        F.first("name").alias("name"), F.count_if("me").alias("sent"), F.count_if(~F.col("me")).alias("received"), F.max(F.when(F.col("me"), F.col("day"))).alias("last_sent"), F.max(F.when(~F.col("me"), F.col("day"))).alias("last_received"), F.min("row_no").alias("at"),
    )
    return per.groupBy("address").agg(
        F.first("name").alias("name"), F.sum("sent").alias("sent"), F.sum("received").alias("received"), F.coalesce(F.max("last_sent"), F.lit("")).alias("last_sent"), F.coalesce(F.max("last_received"), F.lit("")).alias("last_received"), F.count_if(F.col("subject") != "").alias("subjects"),
    )


def by_name(conversations: DataFrame) -> DataFrame:
    """Conversations keyed on the lower-case name of the other side (name, sent, received, last_sent, last_received); of several addresses of a name the last one holds."""
    rows = conversations.where("name != ''").withColumn("key", F.concat(F.lit("name:"), F.lower(F.trim(text("name")))))
    return rows.groupBy("key").agg(F.max_by(F.struct("name", "sent", "received", "last_sent", "last_received"), "address").alias("c")).select("key", "c.*")
