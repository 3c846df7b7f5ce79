"""Linking the spellings under which people type one organisation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomline.llm.kept import Kept, unite, with_kept
from loomline.llm.namekeys import NAME_STEPS, read_name, segments, shouted, slip, sought
from loomline.operators.skew import join_hot
from loomline.runtime import cut, ship

Steps = tuple[tuple[int, int], ...]
#: Edits at most between names of which one does not tell its sector.
LOOSE = 2
_READ = "name string, node string, core string, turned string, sector string, words array<string>, plain boolean"


def read_rows(names: list[str | None]) -> dict[str, pa.Array]:
    """Of typed names, remembered for a batch: node (core and sector, null for none), core, turned core, sector, words, and whether slips may be looked for."""
    known: dict[str, tuple] = {}
    for name in set(names) - {None}:
        core, turned, sector, words = read_name(name)
        known[name] = (f"{core}|{sector}", core, turned, sector, words, not shouted(name)) if core else (None, "", "", "", [], False)
    rows = [known[x] if x is not None else (None, "", "", "", [], False) for x in names]
    types = {"node": pa.string(), "core": pa.string(), "turned": pa.string(), "sector": pa.string(), "words": pa.list_(pa.string()), "plain": pa.bool_()}
    return {k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(types.items())}


def read_names(names: DataFrame) -> DataFrame:
    """Distinct strings of the column ``name`` as read; placeholders and names without words are left out."""
    ship(names.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = read_rows(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols.values()], ["name", *cols])

    return names.select("name").where("name is not null").distinct().mapInArrow(read, _READ).where("node is not null")


def forms_of(read: DataFrame) -> DataFrame:
    """Each distinct way of reading a node: form, node, core, turned, sector, words, plain."""
    columns = ["node", "core", "turned", "sector", "words", "plain"]
    return read.select(F.xxhash64(*columns).alias("form"), *columns).dropDuplicates(["form"])


def keyed(texts: DataFrame, of: str, steps: Steps) -> DataFrame:
    """``texts`` (text and others) once per key: of the segments it has (``of`` = "held"), or of those that a word within reach may have ("sought")."""
    ship(texts.sparkSession)
    make = segments if of == "held" else sought
    columns = texts.columns
    at = columns.index("text")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [list(make(x, steps)) for x in batch.column(at).to_pylist()]
            rows = pa.array([i for i, ks in enumerate(each) for _ in ks], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k for ks in each for k in ks], pa.int64()), *(c.take(rows) for c in batch.columns)], ["key", *columns])

    if of == "sought":
        # a word gives a hundred keys, so few words must not meet in a task because they are small
        texts = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return texts.mapInArrow(keys, "key bigint, " + ", ".join(f"{n} {t}" for n, t in texts.dtypes))


def near_pairs(probes: DataFrame, index: DataFrame, steps: Steps, meet: str = "true", most: str = "99") -> DataFrame:
    """Pairs (a, b, text, other) of ``probes`` and ``index`` (key, id, text and others) within the edits that ``steps`` allow.

    Keys meet by ``join_hot``, so a segment that many names share is split.
    ``meet`` is a condition on the columns of both sides, those of the index
    with ``_b``; ``most`` a column that lowers the number of edits.
    """
    other = index.select("key", *[F.col(c).alias(f"{c}_b") for c in index.columns if c != "key"])
    met = join_hot(other, probes, "key").where("id != id_b").where(meet)
    met = met.select(F.col("id").alias("a"), F.col("id_b").alias("b"), "text", F.col("text_b").alias("other"), F.expr(most).cast("int").alias("most")).distinct()

    @F.pandas_udf("boolean")
    def near(x, y, most):
        import pandas as pd

        return pd.Series([slip(p, q, steps, int(m)) for p, q, m in zip(x, y, most)])

    # the built-in distance counts a swap of neighbours twice; it is the cheaper test and goes first
    far = 2 * max(k for _, k in steps)
    return met.where(F.levenshtein("text", "other", far) >= 0).where(near("text", "other", "most")).select("a", "b", "text", "other").distinct()


def name_keys(forms: DataFrame) -> DataFrame:
    """Keys under which names meet without a slip (key, kind, node): bag of words, core, words of several, sole word."""
    long = F.filter("words", lambda w: F.length(w) >= 4)
    one = F.get(long, F.lit(0))
    rows = forms.select(
        "node",
        F.array(
            F.when(F.size("words") > 1, F.struct(F.lit("bag").alias("kind"), F.array(F.xxhash64(F.lit("bag"), F.concat_ws(" ", F.array_sort("words")), "sector")).alias("keys"))),
            F.struct(F.lit("core").alias("kind"), F.array(F.xxhash64(F.lit("core"), "core")).alias("keys")),
            F.when(F.size(long) > 1, F.struct(F.lit("word").alias("kind"), F.transform(long, lambda w: F.xxhash64(F.lit("word"), w)).alias("keys"))),
            F.when((F.size(long) == 1) & (F.length(one) >= 6), F.struct(F.lit("sole").alias("kind"), F.array(F.xxhash64(F.lit("word"), one)).alias("keys"))),
        ).alias("all"),
    )
    return rows.select("node", F.explode("all").alias("x")).where("x is not null").select("node", "x.kind", F.explode("x.keys").alias("key")).select("key", "kind", "node").distinct()


def link_names(forms: DataFrame, entered: DataFrame | None, kept: Kept | None = None) -> tuple[DataFrame, DataFrame]:
    """Unite the employers' nodes that new ``forms`` bring: the representatives that changed (old, rep) and the new mapping rows (node, rep).

    With ``kept`` only its entries under the keys of the new forms are read,
    and what the new forms add is appended.  Whichever of two names came
    first, they meet: both forms of a name are indexed and both are looked up.
    ``entered`` are nodes that an alias joins (a, b).
    """
    both = F.array(F.struct(F.col("core").alias("text"), F.lit(False).alias("turn")), F.struct(F.col("turned").alias("text"), F.lit(True).alias("turn")))
    texts = forms.where("plain").select(F.col("node").alias("id"), "sector", F.explode(both).alias("t")).select("id", "sector", "t.text", "t.turn").where("not turn or text != split_part(id, '|', 1)").distinct()
    index, probes = cut(keyed(texts, "held", NAME_STEPS)), cut(keyed(texts, "sought", NAME_STEPS))
    met = with_kept(None if kept is None else kept.probe("segments", probes, "key"), index)
    compatible = "(sector = sector_b or sector = '' or sector_b = '') and not (turn and turn_b)"
    links = near_pairs(probes, met, NAME_STEPS, compatible, f"if(sector = '' or sector_b = '', {LOOSE}, 99)").select("a", "b")

    keys = cut(name_keys(forms))
    held = with_kept(None if kept is None else kept.probe("name_keys", keys, "key"), keys).distinct()
    held = held if kept is None else cut(held)
    # a bag holds no more nodes than its words have orders
    bags = held.where("kind = 'bag'").groupBy("key").agg(F.min("node").alias("a"), F.collect_set("node").alias("all")).where(F.size("all") > 1).select("a", F.explode("all").alias("b"))
    cores = held.where("kind = 'core'").groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 2 and (a like '%|' or b like '%|')").select("a", "b")
    links = links.unionAll(bags).unionAll(cores)
    if entered is not None:
        links = links.unionAll(entered)
    changed, moved = unite(links, kept, "employers")

    # names of one long word join the one organisation that has this word among others
    sole = held.where("kind in ('word', 'sole')")
    if kept is None:
        reps = sole.join(moved.groupBy("node").agg(F.min("rep").alias("rep")), "node", "left")
    else:
        earlier = kept.probe("employers", sole, "node")
        reps = sole.join(with_kept(earlier, moved).groupBy("node").agg(F.min("rep").alias("rep")), "node", "left")
    reps = reps.withColumn("rep", F.coalesce("rep", "node"))
    single = reps.where("kind = 'word'").groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a = z").select("key", "a")
    further, added = unite(reps.where("kind = 'sole'").select("key", F.col("rep").alias("b")).join(single, "key"), kept, "employers", moved)
    rows = cut(moved.unionAll(added).groupBy("node").agg(F.min("rep").alias("rep")))
    olds = changed.select("old").unionAll(further.select("old")).distinct()
    if kept is not None:
        kept.append("segments", index, "key")
        kept.append("name_keys", keys, "key")
        kept.append("employers", rows, "node")
        kept.append("employers_of", rows, "rep")
    return olds.join(rows.withColumnRenamed("node", "old"), "old"), rows


def entered_links(aliases: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """Of aliases as the user has entered them: their readings, and the pairs of nodes (a, b) that they join."""
    if aliases is None:
        return None, None
    pairs = aliases.where("canonical is not null and spelling is not null").select("canonical", "spelling").distinct()
    read = cut(read_names(pairs.select(F.col("canonical").alias("name")).unionAll(pairs.select("spelling"))))
    at = read.select("name", "node")
    return read, pairs.join(at.toDF("canonical", "a"), "canonical").join(at.toDF("spelling", "b"), "spelling").select("a", "b")


def organisations(names: list[DataFrame], aliases: DataFrame | None = None) -> DataFrame:
    """Each distinct string of the ``company`` columns that names an organisation, with its organisation: name, org.

    A name is folded, freed of legal forms, places in brackets and its
    sector, and the rest joined to a core.  Cores are cut into k + 1 segments
    in an inverted index; substrings of every core, and of it with its parts
    turned round, are looked up there at all shifts within k, and what meets
    is verified with a banded edit distance.  k goes by the length of the
    shorter core (``NAME_STEPS``: one edit from four letters, three from
    eight), two at most where one name tells no sector; cores of other
    sectors do not link.  Names under four letters, and single words typed in
    capitals only (short forms), link when equal.  The same words in any
    order link, entered aliases link as they say, and a name of one long word
    joins the one organisation that has this word.

    Null, blank and placeholder names have no row; strings repeated in one or
    several tables have one; empty tables give an empty result; other columns
    are not read.
    """
    strings = reduce(DataFrame.unionAll, [t.select(F.col("company").alias("name")) for t in names])
    read = cut(read_names(strings))
    entered, links = entered_links(aliases)
    _, rows = link_names(cut(forms_of(read if entered is None else read.unionByName(entered))), links)
    return read.join(rows, "node", "left").select("name", F.coalesce("rep", "node").alias("org"))


def same_organisation(names: list[DataFrame], aliases: DataFrame | None = None) -> DataFrame:
    """Each pair (name_a, name_b) of different strings as stored that name one organisation, the smaller first.

    The pairs are what is asked for; ``organisations`` gives the same in one
    row per string.
    """
    orgs = cut(organisations(names, aliases))
    return join_hot(orgs.select("org", F.col("name").alias("name_a")), orgs.select("org", F.col("name").alias("name_b")), "org").where("name_a < name_b").select("name_a", "name_b")
