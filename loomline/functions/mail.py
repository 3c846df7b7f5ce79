"""What single mails say: their class, employer, person, agency and role, as column functions over a message table.

The functions read the columns sender, recipient, subject, snippet, body and
from_me; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomline.functions.keys import company_key, text
from loomline.functions.wording import clean_subject, unwrapped

# Senders of applicant systems and how they name the employer, relays, job alerts, mail hosts of private people.
APPLICANT_SYSTEMS = {
    "myworkday.com": "tenant", "icims.com": "tenant", "ashbyhq.com": "body", "hire.lever.co": "body", "lever.co": "body", "greenhouse.io": "body",
    "smartrecruiters.com": "body", "workable.com": "body", "breezy.hr": "body", "jobvite.com": "body", "taleo.net": "body", "successfactors.com": "body",
}
RELAYS = ("hit-reply@linkedin.com", "inmail-hit-reply@linkedin.com")
INMAIL = "inmail-hit-reply@"
ALERTS = ("jobs-noreply@linkedin.com", "jobalerts-noreply@linkedin.com", "notifications-noreply@linkedin.com", "job-alerts@", "noreply@indeed.com", "alerts@", "jobalerts@")
CONSUMER_HOSTS = ("gmail.com", "googlemail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "me.com", "aol.com", "proton.me", "protonmail.com", "live.com", "msn.com", "comcast.net", "mac.com")
NO_REPLY = r"(?i)^(no-?reply|donotreply|notifications?|mailer|bounce|support|info|alerts?|jobs-noreply|.*-noreply)@"
# What receipts, rejections, invitations and approaches say.
APPLIED = r"(?i)(thank(s| you) for (applying|your application|your interest)|we (just )?received your application|your application (has been |was )?receiv|thanks for applying|application (was )?submitted|we appreciate your interest)"
REJECTED = (
    r"(?i)(we(?:'ve| have)? ?(?:made the )?deci(?:de|ded|sion)|not (be )?(moving|move) forward|will not be (moving|progress)|unfortunately[^.]{0,60}(not|unable|other candidate)|"
    r"pursu\w+ other candidates|position has been filled|role (has been|is) filled|no longer (available|open|accepting)|not (to )?(be )?select|we (did not|didn't) (select|move))"
)
INTERVIEW = r"(?i)(upcoming interview|your (confirmed )?interview|interview (confirmed|scheduled|reminder)|recruiter screen|phone screen|schedule (a|your) (call|chat|interview)|invitation to interview|next (step|round))"
PITCH = (
    r"(?i)(opportunit|hiring for|we('| a)re (growing|hiring|looking)|i('m| am) (a |an )?(recruit|talent|technical recruit|working with|supporting|reaching)|came across your (profile|background)|"
    r"saw your (profile|work|background)|are you (on the job market|open to|interested)|reaching out|role (at|with)|position (at|with)|your background)"
)
# Where employers, agencies and people are named, most telling first; names that are none, words of titles.
NAME_END = r"(?:[!.,\n]|\s+(?:and|we|our|for|to|as)\b)"
COMPANIES = tuple(
    p + NAME_END
    for p in (
        r"(?i)(?:role|position) (?:at|with) ([A-Z][\w&.'’\- ]{1,48}?)",
        r"(?i)thank(?:s| you) for applying (?:to|for) ([A-Z][\w&.'’\- ]{1,48}?)",
        r"(?i)your (?:recent )?interest in (?:working (?:with|at) )?(?:us at )?([A-Z][\w&.'’\- ]{1,48}?)",
        r"joining (?:the team at |our team at |)([A-Z][\w&.'’\- ]{1,48}?)",
        r"interview with ([A-Z][\w&.'’\- ]{1,48}?)",
        r"application (?:to|for) ([A-Z][\w&.'’\- ]{1,48}?)",
    )
)
HIRING = (
    r"(?:here|we|role|position|opening)\s+(?:at|with)\s+([A-Z][\w&.'’\- ]{1,40}?)(?:[.,!\n]|\s+(?:and|within|in|for|to)\b)",
    r"recruiting\s+(?:an?|the)?\s?[\w ]{0,40}?\bfor\s+([A-Z][\w&.'’\- ]{1,40}?)(?:[.,!\n])",
    r"hiring\s+for\s+([A-Z][\w&.'’\- ]{1,40}?)(?:[.,!\n])",
    r"(?m)(?:Talent Acquisition|Recruit\w*|Engineering)\s+at\s+([A-Z][\w&.'’\- ]{1,40}?)(?:[.,!\n|]|$)",
)
AGENCIES = (
    r"recruit\w*\s+(?:with|at|for)\s+([A-Z][\w&.'’\- ]{1,40}?)(?:[.,!\n]|\s+(?:and|who|working))",
    r"i(?:'m| am)\s+(?:currently\s+)?(?:with|at)\s+([A-Z][\w&.'’\- ]{1,40}?)(?:[.,!\n])",
    r"on behalf of\s+(?:our client\s+)?([A-Z][\w&.'’\- ]{1,40}?)(?:[.,!\n])",
)
RELAY_HEADER = r"(?m)^\s*([A-Z][\w’'\-]+(?:\s+[A-Z][\w’'\-]+){0,2})(?:,\s*[A-Za-z.]{2,8})?\s*\n\s*Reply\s*$"
PEOPLE = (
    r"[Mm]y name is ([A-Z][a-z’'\-]+(?: [A-Z][a-z’'\-]+){0,2})",
    r"(?m)^(?:hi|hello|hey)[^,\n]{0,40},?\s*(?:my name is )?([A-Z][a-z’'\-]+(?: [A-Z][a-z’'\-]+){0,2})[,.]",
    r"(?mi)(?:regards|thanks|best|sincerely|cheers)[,!]?\s*\n+\s*([A-Z][a-z’'\-]+(?: [A-Z][a-z’'\-]+){0,2})\s*$",
)
CREDENTIAL = r"(?i)\s+(?:MSc|MS|MBA|PhD|PHR|SHRM|CPC|BSc|MA)\.?$"
NO_NAMES = (
    "the there this that hope just thanks thank please would could unfortunately apologies sorry looking great perfect absolutely hi hello hey your our we i you team role position best"
).split()
TITLE_LIKE = r"(?i)\b(engineer|scientist|developer|manager|director|analyst|architect|specialist|lead|intern|associate|consultant|designer|researcher|technician|administrator|officer|president|position|role)\b"
SUBJECT_ROLES = (
    r"(?i)(?:opportunit\w*|opening|vacancy) for (?:an?|the )?([\w/&,\-\(\) ]{4,60}?)(?: role| position|$)",
    r"(?i)(?:application|apply(?:ing)? (?:to|for)|interest in) (?:the )?([\w/&,\-\(\) ]{4,60}?) (?:role|position)",
    r"(?i)^([\w/&,\-\(\) ]{4,60}?) (?:role|position|opportunit)",
    r"\|\s*([\w/&,\-\(\) ]{4,60}?)\s*(?:\||$)",
    r"(?i)(?:hiring|recruiting) for (?:an?|the )?([\w/&,\-\(\) ]{4,60})",
)
TEXT_ROLES = (
    r"(?i)(?:application|apply(?:ing)?|interest in) (?:for |to )?(?:the )?([\w/&,\-\(\) ]{4,60}?) (?:role|position)",
    r"(?i)for the ([\w/&,\-\(\) ]{4,60}?) (?:role|position)",
)
CLAUSE = r"(?is)\s+(?:and|for|to|as|we|our|role|position|team)\b.*$"
ROBOT_END = r"(?i)[._\-]?(no-?reply|donotreply|careers|jobs|talent|hr)$"
ROBOT = r"(?i)^(no-?reply|donotreply|info|mail)$"


def _first(*found: Column) -> Column:
    """The first of some texts that is not empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in found], F.lit(""))


def message_text() -> Column:
    """Subject, snippet and body, empty ones left out, on lines of their own."""
    return F.concat_ws("\n", *[F.nullif(F.col(c), F.lit("")) for c in ("subject", "snippet", "body")])


def sender_domain() -> Column:
    return F.lower(F.regexp_extract(text("sender"), r"@([\w.\-]+)", 1))


def counterpart() -> Column:
    """The other side's address, whichever direction the mail went."""
    return F.lower(F.trim(F.coalesce(F.when(F.col("from_me"), F.col("recipient")).otherwise(F.col("sender")), F.lit(""))))


def system_kind() -> Column:
    """How the applicant system that sent a mail names the employer: tenant, body, or "" for no such system."""
    domain, out = sender_domain(), F.lit("")
    for host, kind in reversed(APPLICANT_SYSTEMS.items()):
        out = F.when((domain == host) | domain.endswith(f".{host}"), kind).otherwise(out)
    return out


def _holds(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def mail_class() -> Column:
    """alert, rejection, interview, application, recruiter or other; the first that applies in this order of tests."""
    sender, said, mine = F.lower(text("sender")), message_text(), F.coalesce(F.col("from_me"), F.lit(False))
    system = system_kind() != ""
    return (
        F.when(_holds(sender, ALERTS), "alert")
        .when(said.rlike(REJECTED), "rejection")
        .when(said.rlike(INTERVIEW), "interview")
        .when(system & said.rlike(APPLIED), "application")
        .when(sender.contains(INMAIL) & ~mine, "recruiter")
        .when(_holds(sender, RELAYS) & ~mine, F.when(said.rlike(PITCH), "recruiter").otherwise("other"))
        .when(system, "application")
        .when(said.rlike(PITCH) & ~mine, "recruiter")
        .otherwise("other")
    )


def tidy_company(raw: Column) -> Column:
    """A phrase as an employer's name: cut where a clause begins, articles dropped; "" for stop words, titles and odd lengths."""
    whole = F.regexp_replace(F.btrim(raw, F.lit(" \t\n,.!-—")), r"\s+", " ")
    name = F.btrim(F.regexp_replace(whole, CLAUSE, ""), F.lit(" ,.!-"))
    bare = F.trim(F.regexp_replace(name, r"(?i)^(?:the|a|an)\s+", ""))
    bad = (F.length(name) < 2) | (F.length(name) > 48) | F.lower(bare).isin(*NO_NAMES) | bare.rlike(TITLE_LIKE)
    return F.when(bad, "").otherwise(bare)


def _prose() -> Column:
    return unwrapped(_first(text("body"), text("snippet")))


def employer(kind: Column | None = None) -> Column:
    """The employer that a mail names: in an approach as who hires, then by the wording of receipts, then by the tenant in the sender's address."""
    kind = mail_class() if kind is None else kind
    said, prose = message_text(), _prose()
    hiring = [F.when(kind == "recruiter", tidy_company(F.regexp_extract(prose, p, 1))) for p in HIRING]
    told = [tidy_company(F.regexp_extract(said, p, 1)) for p in COMPANIES]
    local = F.regexp_replace(F.regexp_extract(text("sender"), r"^([^@]*)", 1), ROBOT_END, "")
    tenant = F.when((system_kind() == "tenant") & (local != "") & ~local.rlike(ROBOT), F.initcap(F.trim(F.translate(local, "_-", "  "))))
    return _first(*hiring, *told, tenant)


def person() -> Column:
    """The name of who wrote: from the relay's header, or from how people introduce themselves or sign."""
    head = F.trim(F.regexp_replace(F.trim(F.regexp_extract(text("body"), RELAY_HEADER, 1)), CREDENTIAL, ""))
    said = _first(text("body"), text("snippet"))

    def name(c: Column, least: int) -> Column:
        first = F.lower(F.regexp_extract(c, r"^(\S+)", 1))
        return F.when(first.isin(*NO_NAMES) | (F.length(c) < least), "").otherwise(c)

    return _first(name(head, 3), *[name(F.trim(F.regexp_extract(said, p, 1)), 3) for p in PEOPLE])


def agency() -> Column:
    """The staffing firm that an approach names."""
    return _first(*[tidy_company(F.regexp_extract(_prose(), p, 1)) for p in AGENCIES])


def role() -> Column:
    """The title that a mail is about: from its subject, or from its text if it looks like a title."""

    def tidy(c: Column) -> Column:
        r = F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" -,|"))
        return F.when((F.length(r) > 3) & (F.length(r) < 60), r).otherwise("")

    subject, said = clean_subject("subject"), message_text()
    of_subject = [tidy(F.regexp_extract(subject, p, 1)) for p in SUBJECT_ROLES]
    of_text = [tidy(F.regexp_extract(said, p, 1)) for p in TEXT_ROLES]
    return _first(*of_subject, *[F.when(r.rlike(TITLE_LIKE), r) for r in of_text])


def is_human(kind: Column | None = None) -> Column:
    """Whether a person wrote the mail or is written to: relays count, robots and alerts don't, private hosts only with a class."""
    kind, other = mail_class() if kind is None else kind, counterpart()
    host = F.regexp_extract(other, r"@(.*)$", 1)
    return F.when(~other.contains("@") | other.rlike(NO_REPLY), False).when(_holds(other, RELAYS), True).when(host.isin(*CONSUMER_HOSTS), ~kind.isin("alert", "other")).otherwise(kind != "alert")


def employer_label(kind: Column | None = None) -> Column:
    """The employer of a mail by the other side's domain; by its prose for relays, private hosts and applicant systems."""
    other = counterpart()
    host = F.regexp_extract(other, r"@(.*)$", 1)
    stem = F.regexp_replace(F.regexp_replace(host, r"^(mail|email|careers|jobs|talent|hr)\.", ""), r"\.(com|org|net|io|ai|co|gov|edu)(\.[a-z]{2})?$", "")
    of_host = F.replace(F.regexp_extract(stem, r"([^.]*)$", 1), F.lit("-"), F.lit(" "))
    told = employer(kind)
    return F.when(_holds(other, RELAYS), _first(told, agency())).when((host != "") & ~host.isin(*CONSUMER_HOSTS) & (system_kind() == ""), of_host).otherwise(told)


def bucket(kind: Column | None = None) -> Column:
    """The key under which mail of one employer meets; mail that names none meets by thread, or stands alone."""
    key = company_key(employer_label(kind))
    return F.when(key != "", key).otherwise(F.concat(F.lit("thread:"), _first(text("thread_id"), text("message_id"))))
