from collections import Counter

from loomline.operators.deliveries import keep_one, redelivered
from loomline.operators.components import components
from loomline.operators.skew import join_key_facts

SCHEMA = "row_no bigint, message_id string, ll_key string, ll_n string"


def _expected(rows):
    seen, out = set(), set()
    for r, m, *_ in sorted(rows):
        k = (m or "").strip(" <>\t\n")
        if k and k in seen:
            out.add(r)
        seen.add(k)
    return out


def test_redelivered_against_brute_force(spark):
    rows = [(i, [None, "", " <> ", "<a@x>", "a@x ", "b", f"c{i}", "hot"][i % 8], "x", None) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.row_no for r in redelivered(df).collect()} == _expected(rows)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert {r.row_no for r in kept.collect()} == {r for r, *_ in rows} - _expected(rows)


def test_batches_and_ties(spark):
    stored = spark.createDataFrame([(1, "a", "k", "n"), (2, None, "k", "n")], SCHEMA)
    new = spark.createDataFrame([(3, "<a>", "k", "n"), (4, "b", "k", "n"), (4, "b", "k", "n")], SCHEMA)
    assert sorted(r.row_no for r in keep_one(new, stored).collect()) == [1, 2, 4]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert redelivered(df).count() == 0 and keep_one(df).count() == 0


def test_hot_key_join_keeps_all(spark):
    rows = spark.createDataFrame([("h" if i % 3 else f"k{i}", i) for i in range(3000)] + [(None, -1)], "key string, v int")
    facts = rows.where("key is not null").groupBy("key").count().withColumnRenamed("count", "n")
    joined = join_key_facts(rows, facts, "key", "n").collect()
    assert Counter(r.key for r in joined) == Counter(r.key for r in rows.where("key is not null").collect())
    assert all(r.n == (2000 if r.key == "h" else 1) for r in joined)


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (3, 3), (None, 4), (5, 6), (6, 7), (7, 8), (8, 9), (9, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.rep for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got[3] == 1 and got[11] == 10 and got[8] == 5 and got[140] == 100 and 4 not in got
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_filter_that_tells_nothing_loses_nothing(spark):
    from pyspark.sql import functions as F

    from loomline.operators import deliveries

    rows = spark.range(300).select(F.concat(F.lit("k"), F.col("id") % 200).alias("k"))
    repeated = rows.groupBy("k").count().where("count > 1")
    for bits in (32768, 1 << 20):
        told = deliveries.maybe_repeated(rows, deliveries.repeated_filter(repeated, "k", bits), "k", "maybe", bits)
        assert told.count() == 300
        assert told.join(repeated, "k").where("not maybe").isEmpty()


def test_components_of_chains_stars_and_rings(spark):
    from loomline.operators.components import components

    links = [(i, i + 1) for i in range(1000, 1060)] + [(1, i) for i in range(2, 500)] + [(600, 601), (601, 602), (602, 600), (700, 700), (None, 3)]
    got = {r.node: r.rep for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {i: 1000 for i in range(1000, 1061)} | {i: 1 for i in range(1, 500)} | {i: 600 for i in (600, 601, 602)}


def test_join_of_two_hot_sides(spark):
    from loomline.operators.skew import join_hot

    a = spark.range(3000).selectExpr("if(id % 2 = 0, 'hot', 'k' || id) as k", "id as x")
    b = spark.range(50).selectExpr("if(id % 5 = 0, 'hot', 'k' || id) as k", "id as y")
    assert sorted(map(tuple, join_hot(a, b, "k").collect())) == sorted(map(tuple, a.join(b, "k").collect()))
