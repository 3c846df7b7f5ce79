"""Connections, spells and dismissals of people: merges, prioritised lookups, changes between snapshots."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomline.functions.keys import company_key, employer_key, person_key, profile_slug, same_employer, text
from loomline.operators.skew import join_hot, join_key_facts
from loomline.runtime import cut, ship

#: ``alias_pairs``: persons with so many employers are numbered, so many at most, and their employers paired in blocks of about so many.
WIDE, MOST, BLOCK = 64, 1024, 1000


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed for each person (identity, company, position) of ``after``: new, moved or promoted; others have no row.

    Moved is who has a company that is not the same employer as before; a
    blank one before counts as another.  Of several earlier rows of an
    identity the last by (company, position) counts.
    """
    old = before.where("identity != ''").groupBy("identity").agg(F.max(F.struct(text("company").alias("company"), text("position").alias("position"))).alias("was"))
    both = after.join(old, "identity", "left")
    now = F.lower(F.trim(text("position")))
    moved = (text("company") != "") & ~same_employer(F.col("was.company"), F.col("company"))
    kind = F.when(F.col("was").isNull(), "new").when(moved, "moved").when((text("position") != "") & (now != F.lower(F.trim(F.col("was.position")))), "promoted")
    return both.select("identity", "company", "position", kind.alias("change"), F.col("was.company").alias("was_company"), F.col("was.position").alias("was_position")).where("change is not null")


def change_text() -> Column:
    """A change in words."""
    or_ = lambda c, alt: F.coalesce(F.nullif(text(c), F.lit("")), F.lit(alt))
    return (
        F.when(F.col("change") == "new", F.concat(F.lit("new connection — "), or_("position", "role unknown"), F.lit(" at "), or_("company", "company unknown")))
        .when(F.col("change") == "moved", F.concat(or_("was_company", "?"), F.lit(" → "), or_("company", "?")))
        .otherwise(F.concat(or_("was_position", "?"), F.lit(" → "), or_("position", "?"), F.lit(" (same employer)")))
    )


def with_conversations(people: DataFrame, by_profile: DataFrame, by_name: DataFrame) -> DataFrame:
    """People (url, name) with what was said under their profile and under their name, added up: sent, received, last_sent, last_received, two_way.

    Both tables hold each key once.  Dates compare as text; of none "" remains.
    """
    keyed = people.withColumn("ll_slug", profile_slug("url")).withColumn("ll_name", F.concat(F.lit("name:"), F.lower(F.trim(text("name")))))
    pick = lambda t, key, p: t.select(F.col("key").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("sent", "received", "last_sent", "last_received")])
    both = keyed.join(pick(by_profile, "ll_slug", "a"), "ll_slug", "left").join(pick(by_name, "ll_name", "b"), "ll_name", "left")
    n = lambda c: F.coalesce(f"a_{c}", F.lit(0)) + F.coalesce(f"b_{c}", F.lit(0))
    d = lambda c: F.greatest(text(f"a_{c}"), text(f"b_{c}"))
    return both.select(*people.columns, n("sent").alias("sent"), n("received").alias("received"), d("last_sent").alias("last_sent"), d("last_received").alias("last_received"), ((n("sent") > 0) & (n("received") > 0)).alias("two_way"))


def dismissed(leads: DataFrame, dismissals: DataFrame, lead: str, identities: list[str], company: str) -> DataFrame:
    """Leads with the dismissal that covers them: of any of their identities, in that order, or else of their employer; columns of the lead's key and ``covered_by``.

    Every lead is exploded to its few keys, which meet the dismissals (key)
    in one join; the one of the smallest rank wins.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("rank"), person_key(c).alias("key")) for i, c in enumerate(identities)], F.struct(F.lit(len(identities)).alias("rank"), employer_key(company).alias("key")))
    wanted = leads.select(lead, F.explode(keys).alias("k")).select(lead, "k.rank", "k.key").where("key != ''")
    hits = join_hot(wanted, dismissals.select("key").distinct(), "key").groupBy(lead).agg(F.min_by("key", "rank").alias("covered_by"))
    return leads.select(lead).join(hits, lead, "left")


def merged_spells(spells: DataFrame) -> DataFrame:
    """Spells (owner, kind, name, start, end, seq) of one owner with those at the same employer made one: name, start and end.

    In order of ``seq`` a spell joins the first kept one of its kind that is
    the same employer by the name this one has by then; the longer name
    stays, the earliest start counts, and an open end outranks any.  The
    order decides, so the spells of an owner and kind are folded in a group;
    those are one person's and few.
    """
    ship(spells.sparkSession)
    keyed = spells.select("owner", "kind", "name", text("start").alias("start"), text("end").alias("end"), "seq", F.split(company_key("name"), r"\s+").alias("tokens"), company_key("name").alias("key"))
    return keyed.groupBy("owner", "kind").applyInArrow(_fold_spells, "owner string, kind string, name string, start string, end string")


def _fold_spells(table: pa.Table) -> pa.Table:
    from loomline.functions.keys import GENERIC

    kept: list[dict] = []
    for row in sorted(table.to_pylist(), key=lambda r: r["seq"]):
        tokens = set(row["tokens"])
        held = next((k for k in kept if _same(k, row["key"], tokens, set(GENERIC))), None)
        if held is None:
            kept.append({**row, "tokens": tokens})
            continue
        if len(row["name"]) > len(held["name"]):
            held |= {"name": row["name"], "key": row["key"], "tokens": tokens}
        held["start"] = min([d for d in (held["start"], row["start"]) if d], default="")
        held["end"] = max(held["end"], row["end"]) if held["end"] and row["end"] else ""
    names = ["owner", "kind", "name", "start", "end"]
    return pa.table({n: pa.array([k[n] for k in kept], pa.string()) for n in names})


def _same(held: dict, key: str, tokens: set[str], generic: set[str]) -> bool:
    if not held["key"] or not key:
        return False
    shared = {t for t in held["tokens"] & tokens if t not in generic and len(t) > 3}
    return held["key"] == key or bool(shared) and len(shared) / min(len(held["tokens"]), len(tokens)) >= 0.5


def alias_pairs(seen: DataFrame) -> DataFrame:
    """Pairs of employers' keys under which one person (person, employer) is seen, each once, the smaller first.

    Pairs grow with the square of a person's employers, so they are not
    shuffled to be made distinct.  The ``MOST`` persons with the most
    employers, ``WIDE`` at least, are numbered, and each employer carries the
    numbers of those it stands under as bits; a pair comes out under the
    first number that both have.  Pairs of other persons come out if no
    number is shared; they are made distinct only where both employers stand
    under several of these persons.
    """
    rows = cut(seen.select("person", company_key("employer").alias("employer")).where("person != '' and employer != ''").distinct())
    shared = cut(join_key_facts(rows, rows.groupBy("person").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "person", "n"))
    most = shared.where(F.col("n") >= WIDE).select("person", "n").distinct().orderBy(F.desc("n"), "person").limit(MOST)
    wide = cut(most.withColumn("bit", F.row_number().over(Window.orderBy(F.desc("n"), "person")) - 1))
    parts = F.ceil(F.col("n") / BLOCK)
    numbered, blocks = wide.agg(F.count(F.lit(1)), F.sum(parts * (parts + 1) / 2)).first()
    words = [f"w{k}" for k in range(max(1, -(-numbered // 63)))]
    under = shared.join(F.broadcast(wide.select("person", "bit")), "person").select("employer", "n", "bit")
    bits = cut(under.groupBy("employer").agg(*[F.bit_or(F.when(F.floor(F.col("bit") / 63) == k, F.expr("shiftleft(1L, bit % 63)")).otherwise(F.lit(0))).alias(w) for k, w in enumerate(words)]))
    others = _pairs_of_others(shared.join(F.broadcast(wide.select("person")), "person", "left_anti"), bits, words)
    return others.unionAll(_pairs_in_blocks(under, bits, words, int(blocks))) if numbered else others


def _pairs_in_blocks(under: DataFrame, bits: DataFrame, words: list[str], blocks: int) -> DataFrame:
    """Pairs of employers of the numbered persons: employers (employer, n, bit) go into blocks of about ``BLOCK``, each employer meets the lists of its own and of the later blocks, and only there pairs are made."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    held = cut(under.join(bits, "employer").select("bit", parts.alias("parts"), F.pmod(F.xxhash64("employer"), parts).cast("int").alias("part"), "employer", *words))
    lists = held.groupBy("bit", "part").agg(F.collect_list(F.struct("employer", *words)).alias("ys"))
    at, own = F.floor(F.col("bit") / 63), ["bit", "i", "j"]
    # of its bits an employer shows those of persons before this one
    earlier = [F.when(at > k, F.lit(-1)).when(at == k, F.expr("shiftleft(1L, bit % 63) - 1")).otherwise(F.lit(0)).bitwiseAND(F.col(w)).alias(f"x_{w}") for k, w in enumerate(words)]
    left = held.select("bit", F.col("part").alias("i"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("j"), F.col("employer").alias("x"), *earlier)
    # one list for each field, so that a pair reads from them and makes no row of its own
    right = lists.select("bit", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"), *[F.col(f"ys.{c}").alias(f"ys_{c}") for c in ["employer", *words]])
    tasks = max(int(under.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // 4)
    # lists are sent to many, so the size of their table says nothing of a broadcast
    met = left.repartition(tasks, *own).join(right.repartition(tasks, *own).hint("merge"), own)
    each = met.select("i", "j", "x", *[f"x_{w}" for w in words], *[f"ys_{w}" for w in words], F.posexplode("ys_employer").alias("q", "y"))
    before = functools.reduce(lambda a, b: a | b, [F.col(f"x_{w}").bitwiseAND(F.get(f"ys_{w}", F.col("q"))) != 0 for w in words])
    once = each.where(((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))) & ~before)
    return once.select(F.least("x", "y").alias("employer_a"), F.greatest("x", "y").alias("employer_b"))


def _pairs_of_others(shared: DataFrame, bits: DataFrame, words: list[str]) -> DataFrame:
    """Pairs of employers of the persons without a number (person, employer) that stand under no numbered one together."""
    facts = shared.groupBy("employer").agg(F.count(F.lit(1)).alias("m")).join(bits, "employer", "left").select("employer", "m", *[F.coalesce(w, F.lit(0)).alias(w) for w in words])
    rows = cut(join_key_facts(shared.select("person", "employer"), facts, "employer", "m"))

    def met(rows: DataFrame) -> DataFrame:
        far = rows.select("person", F.col("employer").alias("other"), F.col("m").alias("o_m"), *[F.col(w).alias(f"o_{w}") for w in words])
        known = functools.reduce(lambda a, b: a | b, [F.col(w).bitwiseAND(F.col(f"o_{w}")) != 0 for w in words])
        return rows.join(far, "person").where((F.col("employer") < F.col("other")) & ~known)

    pair = lambda df: df.select(F.col("employer").alias("employer_a"), F.col("other").alias("employer_b"))
    return pair(met(rows).where("m = 1 or o_m = 1")).unionAll(pair(met(rows.where("m > 1"))).distinct())


def upsert_registry(registry: DataFrame, proposals: DataFrame, today: str) -> DataFrame:
    """``registry`` (name, why, careers_url, ats, status, applied_to, added) with ``proposals`` (name, why, careers_url, ats, status, applied_to) added by the name's key.

    What is known stays; blanks are filled in, ``applied_to`` stays once it
    is true, and a status only goes from new to resolved.  New names are
    added as of ``today``; of several proposals of a key the smallest value
    that fills a field counts.  Names without a key are left out.
    """
    new = proposals.withColumn("ll_key", company_key("name")).where("ll_key != ''").groupBy("ll_key").agg(F.min("name").alias("p_name"), *[F.min(F.nullif(c, F.lit(""))).alias(f"p_{c}") for c in ("why", "careers_url", "ats")], F.max(F.col("status") == "resolved").alias("p_resolved"), F.max("applied_to").alias("p_applied"))
    both = registry.withColumn("ll_key", company_key("name")).join(new, "ll_key", "full_outer")
    fill = lambda c: F.coalesce(F.nullif(c, F.lit("")), f"p_{c}", F.lit("")).alias(c)
    status = F.when(F.col("status").isNull() | (F.col("status") == "new"), F.when(F.coalesce("p_resolved", F.lit(False)), "resolved").otherwise("new")).otherwise(F.col("status"))
    return both.select(F.coalesce("name", "p_name").alias("name"), fill("why"), fill("careers_url"), fill("ats"), status.alias("status"), (F.coalesce("applied_to", F.lit(False)) | F.coalesce("p_applied", F.lit(False))).alias("applied_to"), F.coalesce("added", F.lit(today)).alias("added"))

