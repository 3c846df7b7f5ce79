import random

from loomline.functions import jsontext, keys, wording
from loomline.operators import mailbox, people, records


def _greedy(rows, seen=()):
    ids, pairs, kept = {s[0] for s in seen}, {s[1:] for s in seen if s[1] and s[2]}, []
    for order, i, a, b in sorted(rows):
        if i in ids or a and b and (a, b) in pairs:
            continue
        ids.add(i)
        if a and b:
            pairs.add((a, b))
        kept.append(order)
    return sorted(kept)


def test_deduplication_is_sequential(spark):
    schema = "pos int, id string, a string, b string, ll_o string"
    r = random.Random(3)
    cases = [[(1, "A", "p", "p"), (2, "B", "p", "p"), (3, "B", "x", "x")]]
    cases += [[(n, f"i{r.randrange(12)}", r.choice(["", "x", "y", "z"]), r.choice(["", "u", "v"])) for n in range(60)] for _ in range(3)] + [[]]
    cases.append([(n, f"i{n // 2}", "c", f"t{(n + 1) // 2}") for n in range(24)])  # a chain in which each row decides the next
    for rows in cases:
        df = spark.createDataFrame([(*x, "n") for x in rows], schema)
        got = records.deduplicated(df, "id", ["a", "b"], "pos")
        assert got.columns == df.columns and sorted(x.pos for x in got.collect()) == _greedy(rows)
    old, new = cases[1][:30], cases[1][30:]
    kept = [x for x in old if x[0] in _greedy(old)]
    got = records.deduplicated(spark.createDataFrame([(*x, "n") for x in new], schema), "id", ["a", "b"], "pos", spark.createDataFrame([(*x, "n") for x in kept], schema))
    assert sorted(x.pos for x in got.collect()) == _greedy(new, [x[1:] for x in kept])


MAIL = "row_no int, message_id string, thread_id string, msg_date string, sender string, recipient string, subject string, snippet string, body string, from_me boolean, kind string"


def test_applications_and_approaches(spark):
    rows = [
        (1, "a", "t1", "2026-01-03T09:00:00Z", "kestrel@myworkday.com", "me@x", "Thank you for applying", None, "Thank you for applying to Kestrel Bio and we will review your application.", False, "x"),
        (2, "b", "t1", "2026-01-09T09:00:00Z", "hr@kestrel.example", "me@x", "Your application", None, "After reviewing, we will not be moving forward.", False, "x"),
        (3, "c", "t2", None, "no-reply@myworkday.com", "me@x", "Application for the Data Engineer role", None, "We received your application.", False, "x"),
        (4, "d", "t3", "2026-02-01T09:00:00Z", "Rae Ling <rae@agency.example>", "me@x", "Opportunity for a Platform Engineer role", None, "Hi, my name is Rae Ling. I am hiring for Osprey Systems Ltd. I am a recruiter at Harbour Talent.", False, "x"),
        (5, "e", "t3", "2026-02-02T09:00:00Z", "me@x", "rae@agency.example", "Re: Opportunity", None, "Tell me more.", True, "x"),
        (6, None, None, "unknown", None, None, None, None, None, None, "x"),
    ]
    df = spark.createDataFrame(rows, MAIL)
    got = {x.company_key: x for x in mailbox.applications(df).collect()}
    assert (got["kestrel bio"].status, got["kestrel bio"].applied, got["kestrel bio"].last_heard) == ("rejected", "2026-01-03", "2026-01-09")
    reached = {x.thread: x for x in mailbox.approaches(df).collect()}
    assert set(reached) == {"t3"} and (reached["t3"].person, reached["t3"].agency, reached["t3"].replied, reached["t3"].messages) == ("Rae Ling", "Harbour Talent", True, 2)
    assert mailbox.applications(df.limit(0)).count() == 0 and mailbox.approaches(df.limit(0)).count() == 0
    assert {x.address for x in mailbox.mail_conversations(df).collect()} >= {"rae@agency.example"}


def test_salaries(spark):
    cases = {
        "salary 95000 110000": (95000, 110000), "95,000  110,000 usd": (95000, 110000), "$150k - $180k base": (150000, 180000), "We offer 401k matching and base pay of $120,000": (120000, 120000), "$45.50 per hour": (94640, 94640),
        "team of 12, founded 1999": None, "pay: 40": None, "": None, "salary 20000000": None, "403 (b) plan, salary 70,000": (70000, 70000),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", wording.salary_range("t").alias("s"))
    assert {r.t: (tuple(r.s) if r.s else None) for r in df.collect()} == cases


def test_same_employer_and_spells(spark):
    pairs = {("OpenEye Scientific", "OpenEye, Cadence Molecular Sciences"): True, ("Sandia National Laboratories", "National Renewable Energy Laboratory"): False, ("Acme Inc", "ACME"): True, ("", "Acme"): False, (None, None): False}
    df = spark.createDataFrame(list(pairs), "a string, b string").select("a", "b", keys.same_employer("a", "b").alias("s"))
    assert {(r.a, r.b): r.s for r in df.collect()} == pairs
    spells = [("o", "employer", "OpenEye Scientific", "2019-01-01", "2020-01-01", 1), ("o", "employer", "OpenEye, Cadence Molecular Sciences", "2020-01-02", "", 2), ("o", "school", "OpenEye Scientific", None, "2001-01-01", 3), ("p", "employer", "Acme", "2001-01-01", "2002-01-01", 4)]
    got = {tuple(r) for r in people.merged_spells(spark.createDataFrame(spells, "owner string, kind string, name string, start string, end string, seq int")).collect()}
    assert got == {("o", "employer", "OpenEye, Cadence Molecular Sciences", "2019-01-01", ""), ("o", "school", "OpenEye Scientific", "", "2001-01-01"), ("p", "employer", "Acme", "2001-01-01", "2002-01-01")}


def test_json_in_prose():
    assert jsontext.first_json('say {no} then {"a": [1, {"b": "}"}]} end') == '{"a":[1,{"b":"}"}]}'
    assert jsontext.first_json("```json\n[1]\n```") == "[1]" and jsontext.first_json("none") is None and jsontext.first_json(None) is None


def test_registry_keeps_what_it_knows(spark):
    schema = "name string, why string, careers_url string, ats string, status string, applied_to boolean, added string"
    old = spark.createDataFrame([("Acme Inc", "kept", "", "", "new", True, "2020")], schema)
    new = spark.createDataFrame([("ACME", "other", "u", "a", "resolved", False, None), ("", "x", "", "", "new", False, None), ("Zed", "", "", "", "new", False, None)], schema)
    got = {tuple(r) for r in people.upsert_registry(old, new, "2026").select("name", "why", "careers_url", "status", "applied_to", "added").collect()}
    assert got == {("Acme Inc", "kept", "u", "resolved", True, "2020"), ("Zed", "", "", "new", False, "2026")}
    assert people.upsert_registry(old.limit(0), new.limit(0), "x").count() == 0


def _employers_pairs(rows):
    by = {}
    for p, e in rows:
        if p and e:
            by.setdefault(p, set()).add(e)
    return sorted({(a, b) for es in by.values() for a in es for b in es if a < b})


def test_alias_pairs_come_once(spark, monkeypatch):
    r = random.Random(5)
    many = [(f"p{r.randrange(40)}", f"e{r.randrange(25)}") for _ in range(600)] + [(f"q{n % 90}", f"f{n // 90} x{n % 7}") for n in range(450)]
    cases = [many + many[:50] + [("", "e1"), (None, "e2"), ("p1", None), ("p2", "")], [("p", f"e{n}") for n in range(40)], [("p", "e1"), ("q", "e1"), ("q", "e2")], [("p", "e1")], []]
    for wide, most, block in [(64, 1024, 1000), (3, 70, 4), (2, 2, 1)]:
        for name, value in [("WIDE", wide), ("MOST", most), ("BLOCK", block)]:
            monkeypatch.setattr(people, name, value, raising=False)
        for rows in cases:
            got = people.alias_pairs(spark.createDataFrame(rows, "person string, employer string"))
            assert got.columns == ["employer_a", "employer_b"]
            assert sorted(map(tuple, got.collect())) == _employers_pairs(rows)


def test_alias_pairs_are_not_shuffled(spark):
    rows = spark.range(1500).selectExpr("'p' as person", "concat('e', id) as employer").unionAll(spark.range(1500).selectExpr("concat('q', id div 2)", "concat('e', id)"))
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        each = context.statusStore().executorList(False)
        return sum(each.apply(k).totalShuffleWrite() for k in range(each.size()))

    before = written()
    assert people.alias_pairs(rows).count() == 1500 * 1499 // 2
    assert written() - before < 1_000_000
