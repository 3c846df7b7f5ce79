"""What addresses tell: boards, source classes, titles and places spelled into paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomline.functions.keys import host_of, is_employer_host, path_of, text

# Hosts of applicant systems, public boards and aggregators, most telling first.
SYSTEM_HOSTS = {
    "boards.greenhouse.io": "Greenhouse", "job-boards.greenhouse.io": "Greenhouse", "greenhouse.io": "Greenhouse", "jobs.lever.co": "Lever", "lever.co": "Lever", "jobs.ashbyhq.com": "Ashby", "ashbyhq.com": "Ashby",
    "myworkdayjobs.com": "Workday", "wd1.myworkdaysite.com": "Workday", "wd5.myworkdaysite.com": "Workday", "workday.com": "Workday", "smartrecruiters.com": "SmartRecruiters", "jobs.smartrecruiters.com": "SmartRecruiters",
    "icims.com": "iCIMS", "taleo.net": "Taleo", "oraclecloud.com": "Oracle Recruiting", "apply.workable.com": "Workable", "workable.com": "Workable", "jobs.jobvite.com": "Jobvite", "jobvite.com": "Jobvite",
    "bamboohr.com": "BambooHR", "recruiting.paylocity.com": "Paylocity", "rippling.com": "Rippling", "jobs.polymer.co": "Polymer", "breezy.hr": "Breezy", "recruitee.com": "Recruitee", "teamtailor.com": "Teamtailor",
    "pinpointhq.com": "Pinpoint", "eightfold.ai": "Eightfold", "phenompeople.com": "Phenom", "avature.net": "Avature", "successfactors.com": "SuccessFactors", "brassring.com": "BrassRing", "silkroad.com": "SilkRoad",
    "applytojob.com": "JazzHR", "hire.trakstar.com": "Trakstar", "dover.com": "Dover", "getro.com": "Getro", "consider.com": "Consider",
}
PUBLIC_HOSTS = {"usajobs.gov": "USAJOBS", "governmentjobs.com": "NEOGOV (government)", "schooljobs.com": "NEOGOV (schools)", "interfolio.com": "Interfolio (academic)", "academicjobsonline.org": "AcademicJobsOnline"}
PUBLIC_ENDINGS = (".gov", ".mil", ".edu")
DENIED_HOSTS = (
    "indeed.com ziprecruiter.com glassdoor.com simplyhired.com monster.com careerbuilder.com dice.com talent.com jooble.org neuvoo.com adzuna.com lensa.com jobrapido.com trovit.com upwork.com freelancer.com flexjobs.com "
    "snagajob.com theladders.com beebee.com learn4good.com jobcase.com myjobhelper.com jobs2careers.com getwork.com joblist.com hiring.cafe jobright.ai startup.jobs himalayas.app wellfound.com angel.co builtin.com otta.com "
    "workatastartup.com remoterocketship.com weworkremotely.com remoteok.com remotive.com jobgether.com nodesk.co justremote.co workingnomads.com linkedin.com facebook.com x.com twitter.com reddit.com craigslist.org "
    "jobot.com roberthalf.com randstad.com aerotek.com teksystems.com insightglobal.com kforce.com apexsystems.com motionrecruitment.com cybercoders.com medium.com substack.com quora.com youtube.com"
).split()
CAREER_WORDS = "career job opening position vacan employment opportunit join-us joinus workwithus hiring recruit apply requisition req".split()
SLUG_HOSTS = ("jobs.lever.co", "boards.greenhouse.io", "job-boards.greenhouse.io", "jobs.ashbyhq.com", "apply.workable.com", "breezy.hr", "recruitee.com", "teamtailor.com")
SLUG_ENDING = r"(?i)\.(com|io|ai|co|net|org|dev|xyz|us|bio|tech)$"
HOST_PARTS = {
    "boards.greenhouse.io": "Greenhouse", "job-boards.greenhouse.io": "Greenhouse", "jobs.lever.co": "Lever", "jobs.ashbyhq.com": "Ashby", "apply.workable.com": "Workable", "jobs.smartrecruiters.com": "SmartRecruiters",
    "boards.eu.greenhouse.io": "Greenhouse", "breezy.hr": "Breezy", "recruitee.com": "Recruitee", "jobs.jobvite.com": "Jobvite", "myworkdayjobs.com": "Workday", "icims.com": "iCIMS", "taleo.net": "Taleo", "successfactors.com": "SuccessFactors",
}
LOCALE, ACRONYMS = r"^[a-z]{2}([-_][A-Za-z]{2})?$", ("hp", "ai", "ml", "qa", "it")
SYSTEM_LINK = (
    r"(?i)https?://[\w.-]*(?:job-boards\.greenhouse\.io|boards\.greenhouse\.io|jobs\.lever\.co|jobs\.ashbyhq\.com|myworkdayjobs\.com|jobs\.smartrecruiters\.com|apply\.workable\.com|icims\.com|recruiting\.ultipro\.com|[\w-]+\.jobs)(?:/[\w./%-]*)?"
)
GRID_COMPONENT = "hrs_hram_fl.hrs_cg_search_fl.gbl"


def host_suffixes(host: Column) -> Column:
    """A host and all its endings on label borders, the longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _known(host: Column, hosts: list[str]) -> Column:
    """The first of some hosts of which ``host`` is one or lies under; null for none."""
    return F.get(F.array_intersect(F.array(*[F.lit(h) for h in hosts]), host_suffixes(host)), F.lit(0))


def _named(found: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[found]


def source_class(url: Column | str, company: Column | str) -> Column:
    """Where a posting comes from, as struct of class (denied, ats, public, employer, unknown) and label; the first that applies in this order."""
    host = host_of(url)
    denied, system, public = _known(host, list(DENIED_HOSTS)), _known(host, list(SYSTEM_HOSTS)), _known(host, list(PUBLIC_HOSTS))
    both = lambda kind, label: F.struct(F.lit(kind).alias("class"), label.alias("label"))
    ends = F.lit(False)
    for ending in PUBLIC_ENDINGS:
        ends = ends | host.endswith(ending)
    say = lambda form: F.format_string(form, host)
    return (
        F.when(host == "", both("denied", F.lit("no URL")))
        .when(denied.isNotNull(), both("denied", F.format_string("aggregator or staffing site (%s)", denied)))
        .when(system.isNotNull(), both("ats", _named(system, SYSTEM_HOSTS)))
        .when(public.isNotNull(), both("public", _named(public, PUBLIC_HOSTS)))
        .when(ends, both("public", say("government/academic site (%s)")))
        .when(is_employer_host(host, company), both("employer", say("employer site (%s)")))
        .otherwise(both("unknown", say("unrecognised site (%s)")))
    )


def careers_like(url: Column | str) -> Column:
    """Whether an address looks like one for jobs: on an applicant system, or by a word in it."""
    low = F.lower(text(url))
    return (source_class(url, F.lit(""))["class"] == "ats") | F.exists(F.array(*[F.lit(w) for w in CAREER_WORDS]), lambda w: low.contains(w))


def clean_board_url(url: Column | str) -> Column:
    """An address of a board whose first path segment is a name; an ending such as ``.com`` typed onto it is dropped."""
    u, parts = text(url), F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    clean = F.regexp_replace(first, SLUG_ENDING, "")
    scheme = F.coalesce(F.nullif(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit("")), F.lit("https"))
    site = F.regexp_extract(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"^([^/?#]*)", 1)
    whole = F.concat(scheme, F.lit("://"), site, F.lit("/"), F.array_join(F.concat(F.array(clean), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))), "/"))
    return F.when(_known(host_of(url), list(SLUG_HOSTS)).isNotNull() & (clean != first) & (clean != ""), whole).otherwise(u)


def board_parts(url: Column | str) -> Column:
    """Struct of host, tenant and site of a careers address; a language in the path is skipped."""
    host = host_of(url)
    parts = F.filter(F.split(path_of(url), "/"), lambda p: (p != "") & ~p.rlike(LOCALE))
    return F.named_struct(F.lit("host"), host, F.lit("tenant"), F.substring_index(host, ".", 1), F.lit("site"), F.coalesce(F.get(parts, F.lit(0)), F.lit("")))


def slug_title(slug: Column) -> Column:
    """Words of a hyphened name with capitals; short forms such as AI in capitals only."""
    words = F.filter(F.split(F.replace(slug, F.lit("_"), F.lit("-")), "-"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.lower(w).isin(*ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 10_000))))), " ")


def listed_place(place: Column) -> Column:
    """``US-NM-Santa Fe`` as ``Santa Fe, NM``; any other place trimmed."""
    p = F.trim(place)
    return F.when(p.rlike(r"^US-[A-Z]{2}-.+$"), F.concat(F.trim(F.regexp_extract(p, r"^US-[A-Z]{2}-(.+)$", 1)), F.lit(", "), F.regexp_extract(p, r"^US-([A-Z]{2})-", 1))).otherwise(p)


def system_of_host(host: Column) -> Column:
    """The applicant system whose host stands anywhere in ``host``; "" for none."""
    out = F.lit("")
    for part, name in reversed(HOST_PARTS.items()):
        out = F.when(F.lower(host).contains(part), name).otherwise(out)
    return out


def is_grid(url: Column | str) -> Column:
    """Whether an address is that of a board whose results come as a grid of cells."""
    return F.lower(text(url)).contains(GRID_COMPONENT)


def board_behind(url: Column | str, body: Column | str) -> Column:
    """The board that a careers page leads to: the first link to an applicant system, cut back to the board; the address itself if it is one; "" for none."""
    links = F.regexp_extract_all(text(body), F.lit(SYSTEM_LINK), F.lit(0))
    bare = F.transform(links, lambda x: F.rtrim(x, F.lit("\"'&;,)")))
    short = F.transform(bare, lambda x: F.regexp_replace(x, r"(?i)^(.+?)(?:/login|/apply|/job/|/jobs/).*$", "$1"))
    return F.when(_known(host_of(url), list(SYSTEM_HOSTS)).isNotNull(), text(url)).otherwise(F.coalesce(F.get(short, F.lit(0)), F.lit("")))
