"""Normalisation (API and saved shapes), JSON round trip, metadata, chat-log parsing, test encoder."""

import json

import pytest
from pyspark.sql import functions as F

from parley.functions.messages import embed_test, message_metadata
from parley.operators.normalize import normalize_api, normalize_saved, serialize_messages, validate_source
from parley.schemas import RAW_MESSAGE
from parley.sources.chatlog import parse_chat_log

RAW = {
    "id": "700100", "content": "Lunch at the pier?",
    "author": {"id": "4242", "username": "mira"},
    "timestamp": "2023-06-15T08:30:05.250Z", "channel_id": "90210",
    "attachments": [{"id": "a1", "filename": "map.pdf", "size": 8, "url": "u", "proxy_url": "p", "width": None,
                     "height": None, "content_type": "application/pdf"}],
    "reactions": [{"emoji": {"name": "🐙", "id": None}, "count": 2}, {"emoji": {"name": "x", "id": "77"}, "count": 1}],
    "mentions": [{"id": "31", "username": "otto"}],
}


def _raw(spark, objs):
    df = spark.createDataFrame([(json.dumps(o),) for o in objs], "j string")
    return df.select(F.from_json("j", RAW_MESSAGE).alias("r")).select("r.*")


def test_from_api_response(spark):
    m = normalize_api(_raw(spark, [RAW])).first()
    assert m.id == "700100" and m.content == "Lunch at the pier?"
    assert m.author == "mira" and m.author_id == "4242"
    assert m.channel_id == "90210" and m.source == "discord"
    assert [(r.emoji, r["count"]) for r in m.reactions] == [("🐙", 2), ("x", 1)]
    assert m.mentions == ["31"]
    assert m.timestamp.isoformat().startswith("2023-06-15T08:30:05.25")


def test_saved_shape_defaults(spark):
    saved = {"id": 5, "content": "hi", "author": "plainuser", "timestamp": "2025-01-01T12:00:00", "channel_id": "c"}
    m = normalize_saved(_raw(spark, [saved, {"content": None}])).orderBy("id").collect()
    assert (m[1].author, m[1].attachments, m[1].reactions, m[1].mentions) == ("plainuser", [], [], [])
    assert (m[0].id, m[0].content, m[0].author, m[0].timestamp) == ("", "", "unknown", None)


def test_mentions_variants(spark):
    objs = [dict(RAW, mentions=[]), dict(RAW, mentions=[{"id": "1"}, {"username": "x"}, {"id": "2"}]),
            dict(RAW, mentions=["7", "8"])]
    got = [r.mentions for r in normalize_api(_raw(spark, objs)).collect()]
    assert got == [[], ["1", "2"], ["7", "8"]]


def test_round_trip(spark):
    m = normalize_api(_raw(spark, [RAW]))
    back = normalize_saved(serialize_messages(m).select(F.from_json("json", RAW_MESSAGE).alias("r")).select("r.*"))
    a, b = m.first(), back.first()
    for f in ("id", "content", "author", "channel_id", "timestamp", "attachments", "reactions", "mentions", "source"):
        assert a[f] == b[f], f
    doc = json.loads(serialize_messages(m).first().json)
    assert list(doc) == ["id", "content", "author", "timestamp", "channel_id", "attachments", "reactions",
                         "mentions", "source"]
    assert doc["timestamp"] == "2023-06-15T08:30:05.250000+00:00"


def test_metadata_flags(spark):
    m = normalize_api(_raw(spark, [RAW]))
    md = m.select(message_metadata("author", "timestamp", "channel_id", "attachments", "reactions", "mentions")
                  .alias("m")).first().m
    assert (md.author, md.has_attachments, md.has_reactions, md.has_mentions) == ("mira", True, True, True)


def test_invalid_source_is_rejected(spark):
    df = spark.createDataFrame([("1", "discord"), ("2", "irc"), ("3", None)], "id string, source string")
    ok, bad = validate_source(df)
    assert [r.id for r in ok.collect()] == ["1"] and sorted(r.id for r in bad.collect()) == ["2", "3"]


@pytest.mark.parametrize("text,expected", [
    ("", []),
    ("alice (2025-01-01 12:00): hello\nbob (2025-01-01 12:01): hi there\ncarol (2025-01-01 12:02): bye",
     [("0", "alice", "2025-01-01 12:00", "hello"), ("1", "bob", "2025-01-01 12:01", "hi there"),
      ("2", "carol", "2025-01-01 12:02", "bye")]),
    ("dave (t1): see (this) note", [("0", "dave", "t1", "see (this) note")]),
    ("erin (t2): time is 10:30", [("0", "erin", "t2", "time is 10:30")]),
    ("frank (t3): first line\ncontinued here\nstill more", [("0", "frank", "t3", "first line")]),
    ("odd ) line (no close\ngina (t4):ok", [("1", "gina", "t4", "ok")]),
])
def test_parse_chat_log(spark, text, expected):
    df = spark.createDataFrame([(text,)], "text string")
    got = [(r.id, r.author, r.timestamp, r.content) for r in parse_chat_log(df).orderBy("id").collect()]
    assert got == expected


def test_embed_test_encoder(spark):
    df = spark.createDataFrame([("ab",), ("",)], "t string")
    got = [[round(x, 9) for x in r[0]] for r in df.select(embed_test("t")).collect()]
    # 'a' = 97 -> 0.7, 'b' = 98 -> 0.8, blank = 32 -> 0.2
    assert got == [[0.7, 0.8, 0.2, 0.2], [0.2, 0.2, 0.2, 0.2]]


def test_read_chat_log_files(spark, tmp_path):
    from parley.sources.chatlog import read_chat_logs
    (tmp_path / "a.log").write_text("\n\nann (t0): hi\nbob (t1): yo\n")
    (tmp_path / "b.log").write_text("cat (t2): one\nno parens here\ndan (t3): two (2)\n")
    rows = read_chat_logs(spark, str(tmp_path), glob="*.log").collect()
    got = sorted((r.file.rsplit("/", 1)[-1], r.id, r.author, r.content) for r in rows)
    assert got == [("a.log", "0", "ann", "hi"), ("a.log", "1", "bob", "yo"),
                   ("b.log", "0", "cat", "one"), ("b.log", "2", "dan", "two (2)")]


def test_default_ts_and_rejects(spark):
    from parley.operators.normalize import normalize_with_rejects
    objs = [{"id": "1", "content": "a", "timestamp": "2025-01-01T12:00:00Z"},
            {"id": "2", "content": "b", "timestamp": "not a time"},
            {"id": "3", "content": "c", "source": "irc"},
            {"id": "4", "content": "d"}]
    raw = _raw(spark, objs)
    good, bad = normalize_with_rejects(raw)
    assert sorted(r.id for r in good.collect()) == ["1", "4"]
    assert sorted((r.id, r.reason) for r in bad.collect()) == [("2", "timestamp"), ("3", "source")]
    filled = normalize_saved(raw.filter("id = '4'"), default_ts="2020-01-01 00:00:00").first()
    assert filled.timestamp.isoformat().startswith("2020-01-01")
