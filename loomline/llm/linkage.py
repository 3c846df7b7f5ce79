"""Incremental record linkage of postings against all that was accepted before."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomline.llm.kept import Kept, current, unite, with_kept
from loomline.llm.namekeys import TITLE_STEPS, fold
from loomline.llm.names import entered_links, forms_of, keyed, link_names, near_pairs, read_rows
from loomline.operators.skew import join_key_facts
from loomline.runtime import cut, scratch, ship

# Words of titles that tell level or work mode, and short forms of others.
LEVELS = frozenset(
    "senior sr snr junior jr lead principal staff head chief associate mid entry graduate trainee i ii iii iv v remote hybrid onsite on site full part time fulltime parttime permanent contract temporary wfh m f d w x".split()
) - {"site", "time", "on", "associate"}
SHORT_TITLES = {
    "sw": "software", "dev": "developer", "db": "database", "admin": "administrator", "coord": "coordinator", "spec": "specialist", "mgr": "manager", "eng": "engineer", "engr": "engineer",
    "tech": "technician", "ml": "machine learning", "sci": "scientist", "ops": "operations", "acct": "accountant", "rep": "representative", "asst": "assistant", "dir": "director", "consult": "consultant",
    "prog": "programmer", "res": "research", "hw": "hardware", "qa": "quality", "stat": "statistician", "arch": "architect", "des": "designer", "sec": "security", "swe": "software engineer", "sre": "site reliability engineer",
}
_PHRASES = re.compile(r"(?i)\b(?:full|part)[- ]time\b|\bon[- ]site\b|\bmid[- ]level\b|\bentry[- ]level\b|\bwork from home\b")


def title_words(title: str | None) -> list[str]:
    """The words of a title that tell role and field, sorted, each once; level, work mode, order and punctuation dropped."""
    if not title:
        return []
    out: set[str] = set()
    for word in fold(_PHRASES.sub(" ", title)).split():
        if word not in LEVELS:
            out.update(SHORT_TITLES.get(word, word).split())
    return sorted(out)


def url_mark(url: Column) -> Column:
    """The part of a posting's address that names it: the last path segment or query identifier with a digit, in lower case."""
    bare = F.regexp_replace(F.lower(url), r"#.*$|[?&](?:utm_\w+|gh_src|from|src|ref)=[^&#]*", "")
    return F.nullif(F.regexp_extract(bare, r"([a-z]?-?\w*\d[\w-]*)/?$", 1), F.lit(""))


#: A word that slips into another is no slip but a word of its own from so many openings, and from this share of the other's, on.
RIVAL_LEAST, RIVAL_SHARE = 5, 0.2
_PARSED = "pos bigint, mark string, titled array<string>, node string, core string, turned string, sector string, words array<string>, plain boolean"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        titles = [title_words(x) for x in batch.column(3).to_pylist()]
        cols = read_rows(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(titles, pa.list_(pa.string())), *cols.values()], ["pos", "mark", "titled", *cols])


def learn_weights(patterns: list[tuple[str, str, str, int]], rounds: int = 25) -> dict[tuple[int, str], float]:
    """Log weights of agreement by expectation maximisation over counts of comparison patterns (title, company, url level).

    The two classes start from what the levels mean; the counts are one row
    per pattern, at most twelve, whatever the data.
    """
    m = [{"slip": 0.95, "rival": 0.05}, {"same": 0.6, "linked": 0.4}, {"same": 0.6, "differs": 0.2, "missing": 0.2}]
    u = [{"slip": 0.1, "rival": 0.9}, {"same": 0.6, "linked": 0.4}, {"same": 0.05, "differs": 0.75, "missing": 0.2}]
    share = 0.5
    total = sum(n for *_, n in patterns)
    for _ in range(rounds if total else 0):
        gained = []
        for *levels_of, n in patterns:
            a = share * math.prod(m[k][x] for k, x in enumerate(levels_of))
            b = (1 - share) * math.prod(u[k][x] for k, x in enumerate(levels_of))
            gained.append((levels_of, n, a / (a + b)))
        own = sum(n * g for _, n, g in gained)
        share = min(max(own / total, 0.05), 0.95)
        # pseudo-counts of the starting values keep a level that was not seen from deciding alone
        for k in range(3):
            for x in m[k]:
                m[k][x] = (sum(n * g for lv, n, g in gained if lv[k] == x) + 50 * m[k][x]) / (own + 50)
                u[k][x] = (sum(n * (1 - g) for lv, n, g in gained if lv[k] == x) + 50 * u[k][x]) / (total - own + 50)
    out = {(k, x): math.log(m[k][x] / u[k][x]) for k in range(3) for x in m[k]}
    out[(3, "")] = math.log(share / (1 - share))
    return out


def _opening(org: str, words: str) -> Column:
    return F.xxhash64(F.col(org), F.concat_ws(" ", words))


def _blocks(fresh: DataFrame, kept: Kept) -> DataFrame:
    """Blocking keys (key, opening, how) of new openings (opening, org, titled): the opening itself, and what it would be with one word as a commoner one of which it is a slip.

    Slips are found between words, not openings: new words of titles are
    looked up in a segment index of all words.  A slip leads from the word
    that came later, or of one batch the rarer one, so openings of both meet
    under the key of the other word whichever came first.
    """
    counts = cut(fresh.select(F.explode("titled").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    before = kept.probe("words", counts, "word")
    new = counts if before is None else cut(counts.join(before.select("word").distinct(), "word", "left_anti"))
    texts = new.select(F.col("word").alias("id"), "n", F.col("word").alias("text"))
    index, probes = cut(keyed(texts, "held", TITLE_STEPS)), keyed(texts, "sought", TITLE_STEPS)
    if kept.done:
        probes = cut(probes)
    near = near_pairs(probes, with_kept(kept.probe("word_segments", probes, "key"), index), TITLE_STEPS).select("a", "b")
    own = new.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    led = near.join(new.select(F.col("word").alias("a"), "n"), "a").join(own, "b", "left").where("n_b is null or struct(n, a) < struct(n_b, b)")
    near = kept.append("near", led.select(F.col("a").alias("low"), F.col("b").alias("high")).distinct(), "low")
    slips = with_kept(kept.probe("near", counts.select(F.col("word").alias("low")), "low"), near)
    slips = slips.join(counts.select(F.col("word").alias("low")), "low", "left_semi")
    if before is not None:
        # how often words occur is summed over all batches, for the two words of a slip alone
        both = slips.select(F.col("low").alias("word")).unionAll(slips.select("high")).distinct()
        every = with_kept(kept.probe("words", both, "word"), counts)
    else:
        every = counts
    sums = cut(every.groupBy("word").agg(F.sum("n").alias("n")))
    rated = slips.join(sums.select(F.col("word").alias("low"), F.col("n").alias("n_low")), "low").join(sums.select(F.col("word").alias("high"), F.col("n").alias("n_high")), "high")
    least, most = F.least("n_low", "n_high"), F.greatest("n_low", "n_high")
    rated = rated.select("low", "high", F.when((least >= RIVAL_LEAST) & (least >= RIVAL_SHARE * most), 2).otherwise(1).alias("how"))
    kept.append("words", counts, "word")
    kept.append("word_segments", index, "key")
    spread = fresh.select("opening", "org", "titled", F.explode("titled").alias("low")).join(rated, "low")
    turned = spread.withColumn("titled", F.array_sort(F.array_distinct(F.array_append(F.array_remove("titled", F.col("low")), F.col("high")))))
    return fresh.select(F.col("opening").alias("key"), "opening", F.lit(0).alias("how")).unionAll(turned.select(_opening("org", "titled").alias("key"), "opening", "how")).groupBy("key", "opening").agg(F.min("how").alias("how"))


def _compared(new: DataFrame, kept: Kept, traits: DataFrame) -> DataFrame:
    """Comparison patterns (a, b, title, company, url) of openings that meet under a key.

    A key's centre is the opening that it names, or the smallest that slips to
    it; others are compared with the centre, never all with all.  A new
    centre is compared with the earlier ones too.
    """
    held = kept.probe("blocks", new, "key")
    members = new.withColumn("new", F.lit(True))
    if held is not None:
        members = cut(members.unionByName(held.withColumn("new", F.lit(False))).groupBy("key", "opening").agg(F.min("how").alias("how"), F.max("new").alias("new")))
    centre = members.groupBy("key").agg(F.max(F.when(F.col("how") == 0, F.col("opening"))).alias("own"), F.max(F.col("new") & (F.col("how") == 0)).alias("own_new"), F.min("opening").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = members.join(centre, "key").withColumn("b", F.coalesce("own", "least")).where("(new or own_new) and opening != b")
    pairs = cut(met.groupBy(F.col("opening").alias("a"), "b").agg(F.min("how").alias("how")))
    ends = pairs.select(F.col("a").alias("opening")).unionAll(pairs.select("b")).distinct()
    known = with_kept(kept.probe("traits", ends, "opening"), traits).distinct()
    known = cut(known.join(ends, "opening", "left_semi"))
    # each trait of one is looked for among those of the other, so an opening with many addresses multiplies nothing
    hits = pairs.join(known.withColumnRenamed("opening", "a"), "a").join(known.select(F.col("opening").alias("b"), "kind", "value", F.lit(True).alias("hit")), ["b", "kind", "value"], "left")
    flag = lambda kind, c: F.coalesce(F.max((F.col("kind") == kind) & c), F.lit(False))
    hit = F.coalesce("hit", F.lit(False))
    told = hits.groupBy("a", "b", "how").agg(flag("node", hit).alias("node"), flag("mark", hit).alias("mark"), flag("any", F.lit(True)).alias("any_a"), flag("any", hit).alias("any_b"))
    return told.select(
        "a", "b", F.when(F.col("how") == 1, "slip").otherwise("rival").alias("title"), F.when(F.col("node"), "same").otherwise("linked").alias("company"),
        F.when(F.col("mark"), "same").when(F.col("any_a") & F.col("any_b"), "differs").otherwise("missing").alias("url"),
    )


def accept(postings: DataFrame, kept: Kept, aliases: DataFrame | None = None) -> DataFrame:
    """Accept a batch into ``kept``: each posting (first_pos, pos) whose opening is known to be named by a smaller pos, as far as this batch tells anew.

    That are postings of the batch, and earlier ones whose opening turns out
    to be that of still earlier ones; of several rows of a pos over the
    batches the one with the smallest first_pos holds.  Only what stands in
    the kept tables under keys of the batch is read, and only what the batch
    adds or changes is written: forms of names and their segments, title
    words and their segments, blocking keys, traits, representatives, first
    positions.

    Employers' names link as in ``names.organisations``, entered ``aliases``
    included.  An opening is an employer and the words of a title without
    level, work mode, order and punctuation; it may be another one's slip in
    any word, and such pairs are scored by title, company (a spelling in
    common) and address (one in common among all of theirs) with weights
    learned from the counts of all batches.  Employers that are merged take
    their openings along.  What holds only while a name is unambiguous (a core with and without one
    sector, names of one long word) is decided on what was accepted so far
    and not withdrawn later.

    Postings without an employer or without title words name no opening and
    never come out; nor do rows with a null pos.  Of repeated rows (equal
    pos) both name the opening once.  An empty batch changes nothing.
    """
    ship(postings.sparkSession)
    given = postings.where("pos is not null and company is not null and title is not null").select(F.col("pos").cast("bigint").alias("pos"), "company", url_mark(F.col("url")).alias("mark"), "title")
    rows = cut(given.mapInArrow(_parse, _PARSED).where("node is not null and size(titled) > 0"))

    entered, alias_links = entered_links(aliases)
    forms = forms_of(rows)
    if entered is not None:
        forms = forms.unionByName(forms_of(entered)).dropDuplicates(["form"])
    if kept.done:
        forms = cut(forms)
        held = kept.probe("forms", forms, "form")
        forms = forms if held is None else forms.join(held.select("form"), "form", "left_anti")
    forms = cut(forms)
    kept.append("forms", forms.select("form"), "form")
    merged, employers = link_names(forms, alias_links, kept)

    nodes = cut(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    orgs = cut(current(nodes, "node", kept.probe("employers", nodes, "node"), employers).select("node", F.col("rep").alias("org"), "n"))
    keyed_rows = cut(join_key_facts(rows.select("pos", "node", "mark", "titled"), orgs, "node", "n").select("pos", "node", "mark", "titled", "org", _opening("org", "titled").alias("opening")))
    found = keyed_rows.groupBy("opening").agg(F.first("org").alias("org"), F.first("titled").alias("titled"))
    traits = [keyed_rows.select("opening", F.lit("node").alias("kind"), F.col("node").alias("value")), keyed_rows.where("mark is not null").select("opening", F.lit("mark"), "mark"), keyed_rows.where("mark is not null").select("opening", F.lit("any"), F.lit(""))]
    same = None
    carried = kept.probe("openings_of", merged.select(F.col("old").alias("org")), "org") if kept.done else None
    if carried is not None:
        # an employer that was merged takes its openings along
        carried = cut(carried.join(merged.select(F.col("old").alias("org"), "rep"), "org").select(F.col("opening").alias("was"), _opening("rep", "titled").alias("opening"), F.col("rep").alias("org"), "titled").distinct())
        same = carried.select(F.col("was").alias("a"), F.col("opening").alias("b"))
        found = found.unionByName(carried.select("opening", "org", "titled")).dropDuplicates(["opening"])
        theirs = kept.probe("traits", carried.select(F.col("was").alias("opening")), "opening")
        if theirs is not None:
            traits.append(theirs.join(carried.select(F.col("was").alias("opening"), F.col("opening").alias("to")), "opening").select("to", "kind", "value"))
    traits = cut(traits[0].unionAll(traits[1]).unionAll(traits[2]).unionAll(traits[3]).distinct() if len(traits) > 3 else traits[0].unionAll(traits[1]).unionAll(traits[2]).distinct())
    if kept.done:
        found = cut(found)
        known = kept.probe("openings", found, "opening")
        found = found if known is None else found.join(known, "opening", "left_anti")
    fresh = cut(found)

    blocks = cut(_blocks(fresh, kept))
    compared = cut(_compared(blocks, kept, traits))
    patterns = kept.append("patterns", compared.groupBy("title", "company", "url").agg(F.count(F.lit(1)).alias("n")), "title")
    every = with_kept(kept.probe("patterns", kept.spark.createDataFrame([("slip",), ("rival",)], "title string"), "title"), patterns)
    weights = learn_weights([tuple(r) for r in every.groupBy("title", "company", "url").agg(F.sum("n")).collect()])  # at most twelve rows
    score = F.lit(weights[(3, "")])
    for i, field in enumerate(("title", "company", "url")):
        score = score + F.create_map(*[F.lit(v) for (j, x), w in weights.items() if j == i for v in (x, w)])[F.col(field)]
    links = compared.where(score > 0).select("a", "b")
    changed, clusters = unite(links if same is None else links.unionAll(same), kept, "clusters")

    # what of a cluster was first, for the clusters that the batch touches
    of_batch = cut(keyed_rows.groupBy("opening").agg(F.min("pos").alias("low"), F.count(F.lit(1)).alias("n")))
    placed = cut(current(of_batch, "opening", kept.probe("clusters", of_batch.select(F.col("opening").alias("node")), "node") if kept.done else None, clusters))
    olds = changed.select(F.col("old").alias("rep"), F.col("rep").alias("now"))
    firsts = placed.groupBy("rep").agg(F.min("low").alias("first_pos"))
    earlier = None
    if kept.done:
        asked = firsts.select("rep").unionAll(olds.select("rep")).unionAll(olds.select("now")).distinct()
        earlier = kept.probe("firsts", asked, "rep")
    if earlier is not None:
        was = earlier.groupBy("rep").agg(F.min("first_pos").alias("first_pos")).join(olds, "rep", "left").select(F.coalesce("now", "rep").alias("rep"), "first_pos")
        firsts = firsts.select("rep", "first_pos", F.lit(None).cast("bigint").alias("was")).unionAll(was.select("rep", "first_pos", F.col("first_pos")))
        firsts = cut(firsts.groupBy("rep").agg(F.min("first_pos").alias("first_pos"), F.max("was").alias("was")))
    else:
        firsts = cut(firsts.withColumn("was", F.lit(None).cast("bigint")))
    facts = placed.join(firsts, "rep").select("opening", "n", "first_pos")
    out = join_key_facts(keyed_rows.select("pos", "opening"), facts, "opening", "n").select("first_pos", "pos")
    lowered = firsts.where("was > first_pos").select("rep", "first_pos")
    if earlier is not None:
        # openings of which an earlier member was not known to be first
        moved = with_kept(kept.probe("clusters_of", lowered, "rep"), clusters).join(lowered, "rep").select(F.col("node").alias("opening"), "first_pos")
        moved = cut(moved.unionAll(lowered.select(F.col("rep").alias("opening"), "first_pos")).groupBy("opening").agg(F.min("first_pos").alias("first_pos")))
        members = kept.probe("members", moved, "opening")
        if members is not None:
            sizes = members.groupBy("opening").agg(F.count(F.lit(1)).alias("n")).join(moved, "opening")
            out = out.unionAll(join_key_facts(members, sizes, "opening", "n").select("first_pos", "pos"))
    out = cut(out.where("first_pos < pos").distinct())

    kept.append("openings", fresh.select("opening"), "opening")
    kept.append("openings_of", fresh.select("org", "opening", "titled"), "org")
    kept.append("blocks", blocks, "key")
    kept.append("traits", traits, "opening")
    kept.append("clusters", clusters, "node")
    kept.append("clusters_of", clusters, "rep")
    kept.append("firsts", firsts.select("rep", "first_pos"), "rep")
    kept.append("members", keyed_rows.select("opening", "pos"), "opening")
    kept.commit()
    return out


def repeated_postings(postings: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """first_pos and pos of each posting that names an opening already named by a smaller pos.

    Batch 0 is accepted first; what came later is one delta against the tables
    that were kept of it.
    """
    kept = Kept(postings.sparkSession, scratch(postings.sparkSession))
    at_start = accept(postings.where("coalesce(batch_no, 0) <= 0"), kept, aliases)
    later = accept(postings.where("batch_no > 0"), kept, aliases)
    return at_start.unionAll(later).groupBy("pos").agg(F.min("first_pos").alias("first_pos")).select("first_pos", "pos")
