import datetime as dt
import json

import pytest

from loomline.operators import people, upserts
from loomline.sources import boards, exports


def _board(spark, kind, body, url="https://b.example/acme"):
    rows = spark.createDataFrame([("Acme", url, body if isinstance(body, str) or body is None else json.dumps(body))], "company string, url string, body string")
    return boards.board_postings(rows, kind).collect()


def test_boards(spark):
    (r,) = _board(spark, "greenhouse", {"jobs": [{"title": " Dev ", "location": {"name": "X"}, "absolute_url": "u", "updated_at": "2026-01-02T1", "content": "&lt;p&gt;A &amp;amp; B&lt;/p&gt;", "extra": 1}]})
    assert (r.title, r.place, r.posted, r.summary) == ("Dev", "X", dt.date(2026, 1, 2), "A & B")
    (r,) = _board(spark, "lever", [{"text": "T", "categories": {"location": "X"}, "workplaceType": "Hybrid", "createdAt": 1767312000000}])
    assert (r.place, r.posted) == ("X (hybrid)", dt.date(2026, 1, 2))
    got = _board(spark, "ashby", {"jobs": [{"title": "a", "isListed": False}, {"title": "b", "location": "X", "secondaryLocations": [{"location": "x"}, {"location": "Y"}], "isRemote": True}]})
    assert [r.place for r in got] == ["Remote — X; also Y"]
    (r,) = _board(spark, "smartrecruiters", {"content": [{"id": "7", "name": "n", "location": {"city": "C", "remote": True}}]})
    assert (r.place, r.url) == ("Remote — C", "https://jobs.smartrecruiters.com/acme/7")
    (r,) = _board(spark, "rippling", [{"name": "n", "workLocation": {"id": "L"}}])
    assert (r.place, r.posted) == ("L", None)
    for kind in boards.BOARDS:
        assert _board(spark, kind, None) == _board(spark, kind, "no json") == _board(spark, kind, "") == []


def test_contacts_with_preamble(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Notes:\n"As of, today"\n\nFirst Name,Last Name,URL,Email Address,Company,Position,Connected On\nAnn,Lee,u,,"Acme, Inc",Boss,01 Jan 2024\n,,,,,,\n')
    (tmp_path / "b.csv").write_text("nothing,here\n")
    with pytest.raises(Exception, match="no header"):
        exports.read_contacts(spark, str(tmp_path)).collect()
    rows = exports.read_contacts(spark, str(tmp_path), strict=False).collect()
    assert [(r.first_name, r.company, r.connected_on) for r in rows] == [("Ann", "Acme, Inc", "01 Jan 2024")]


def test_mail_archive(spark, tmp_path):
    mail = "From a@x Mon\nMessage-ID: <{0}>\nReferences: <r> <s>\nFrom: a@x\nTo: b@x\nSubject: s{0}\nDate: Mon, 01 Sep 2025 10:00:00 +0000\n\nbody {0}\n"
    (tmp_path / "m.mbox").write_text(mail.format(1) + "\n" + mail.format(2))
    rows = exports.read_mail_archive(spark, str(tmp_path / "m.mbox")).collect()
    assert sorted((r.message_id, r.thread_id, r.subject, r.body.strip()) for r in rows) == [("1", "r", "s1", "body 1"), ("2", "r", "s2", "body 2")]
    assert exports.read_mail_archive(spark, str(tmp_path / "m.mbox"), me=("A@x",), since="2025-09-02").count() == 0
    assert {(r.from_me, r.recipient, r.msg_date) for r in exports.read_mail_archive(spark, str(tmp_path / "m.mbox"), me=("A@x",)).collect()} == {(True, "b@x", "2025-09-01T10:00:00Z")}


def test_log(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"id": "a", "n": 1}\nbroken\n{"id": "a", "n": 2, "more": 0}\n{"id": "b"}\n')
    rows = exports.read_log(spark, str(tmp_path / "h.jsonl"), "id string, n int", "id", "n").collect()
    assert sorted((r.id, r.n) for r in rows) == [("a", 2), ("b", None)]


HISTORY = "id string, status string, reason string, composite double, first_seen string, last_seen string, note string"


def test_history_keeps_what_the_user_did(spark):
    old = spark.createDataFrame([("a", "applied", "", 5.0, "d0", "d0", "mine"), ("b", "dropped", "x", 1.0, "d0", "d0", ""), ("c", "dropped", "x", 1.0, "d0", "d0", "")], HISTORY)
    new = spark.createDataFrame([("a", "dropped", "stale", 6.0), ("b", "recommended", "", 7.0), ("d", "dropped", "y", 2.0), (None, "dropped", "", 0.0)], "id string, status string, reason string, composite double")
    got = {r.id: (r.status, r.first_seen, r.last_seen, r.note) for r in upserts.record_history(old, new, "d1").collect()}
    assert got == {"a": ("applied", "d0", "d1", "mine"), "b": ("recommended", "d0", "d1", ""), "c": ("dropped", "d0", "d0", ""), "d": ("dropped", "d1", "d1", "")}


def test_board_stage_never_goes_back(spark):
    old = spark.createDataFrame([("a", "scored", "T", 9.0, "d0", "d0")], "id string, stage string, title string, composite double, first_seen string, last_scored string")
    new = spark.createDataFrame([("a", "found", "", 0.0), ("b", "found", "N", 0.0)], "id string, stage string, title string, composite double")
    got = {r.id: (r.stage, r.title, r.composite) for r in upserts.merge_board(old, new, "d1").collect()}
    assert got == {"a": ("scored", "T", 9.0), "b": ("found", "N", 0.0)}


def test_snapshot_changes(spark):
    shape = "identity string, company string, position string"
    before = spark.createDataFrame([("p", "Acme", "Dev"), ("q", "Acme", "Dev"), ("r", "Acme", "Dev"), ("gone", "A", "B"), ("t", "", "Dev")], shape)
    after = spark.createDataFrame([("p", "Acme Inc", "Dev"), ("q", "Other", "Dev"), ("r", "ACME", "Boss"), ("s", None, None), ("t", "Acme", "Dev")], shape)
    assert {r.identity: r.change for r in people.snapshot_changes(before, after).collect()} == {"q": "moved", "r": "promoted", "s": "new", "t": "moved"}


def test_marks_and_dismissals(spark):
    history = spark.createDataFrame([("abc1", "found", "n"), ("abd2", "found", ""), ("ab", "dropped", None)], "id string, status string, note string")
    marks = spark.createDataFrame([("abc", "applied", "x"), ("ab", "dismissed", ""), ("a", "applied", ""), ("zz", "applied", ""), (None, "applied", "")], "prefix string, status string, note string")
    assert {tuple(r) for r in upserts.mark_status(history, marks).select("id", "status", "note").collect()} == {("abc1", "applied", "x"), ("abd2", "found", ""), ("ab", "dismissed", None)}
    assert {r.id for r in upserts.forget_transient(history).collect()} == {"abc1", "abd2"}
    gone = spark.createDataFrame([("a", "person", "r", "1"), ("b", "person", "r", "1")], "key string, kind string, reason string, day string")
    changes = spark.createDataFrame([("a", "person", "", "2", True), ("c", "employer", "s", "2", False)], "key string, kind string, reason string, day string, removed boolean")
    assert {r.key for r in upserts.dismiss(gone, changes).collect()} == {"b", "c"}


def test_spells_and_conversations_of_an_export(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Company Name,Title,Started On,Finished On\nAcme,Dev,Jun 2024,\n,x,2020,2021\nZed,Dev,2019,odd\n")
    (tmp_path / "m.csv").write_text("FROM,TO,DATE,SENDER PROFILE URL,RECIPIENT PROFILE URLS\nMe,Ann,2026-01-02 10:00,https://x/in/me,https://x/in/Ann?a\nAnn,Me,2026-01-03 10:00,https://x/in/ann,https://x/in/me\nMe,,2026-01-03,https://x/in/me,\n")
    assert {tuple(r) for r in exports.read_spells(spark, str(tmp_path / "p.csv"), None).collect()} == {("employer", "Acme", "2024-06-01", ""), ("employer", "Zed", "2019-01-01", "odd")}
    assert [tuple(r) for r in exports.read_conversations(spark, str(tmp_path / "m.csv"), "Me").collect()] == [("ann", "Ann", 1, 1, "2026-01-02", "2026-01-03")]
