"""Queries: message normalisation, metadata, JSON, chat logs, embeddings, encryption
(N1-N7, F7, S2, E2, E3, X1, K4, S8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.messages import embed_test, message_metadata
from parley.operators.embed import embed_hashing_long
from parley.operators.normalize import normalize_api, normalize_saved, serialize_messages, validate_source
from parley.plans.registry import register
from parley.plans.tables import CONV_SQL, EVENTS_SQL, conversations_as_messages, events_as_messages
from parley.schemas import RAW_MESSAGE
from parley.sources.chatlog import parse_chat_log
from parley.sources.secure import decrypt_rows, encrypt_rows

# Parameter: a 256-bit key for the encryption round trip (a user passes their own).
ROUNDTRIP_KEY = b"0123456789abcdef0123456789abcdef"


@register("embed_test", f"""
select conv_id, turn,
       ((ord(substring(rpad(content, 4, ' '), 1, 1)) % 10)::double * 0.1::double) e1,
       ((ord(substring(rpad(content, 4, ' '), 2, 1)) % 10)::double * 0.1::double) e2,
       ((ord(substring(rpad(content, 4, ' '), 3, 1)) % 10)::double * 0.1::double) e3,
       ((ord(substring(rpad(content, 4, ' '), 4, 1)) % 10)::double * 0.1::double) e4
from {CONV_SQL}""")
def q_embed_test(spark, sf):
    """The test encoder, four components per text."""
    c = conversations_as_messages(spark, sf)
    v = embed_test("content")
    return c.select("conv_id", "turn", *[v[i].alias(f"e{i + 1}") for i in range(4)])


@register("embed_hashing", """
with t as (select conv_id, turn, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) w from conversations),
b as (select conv_id, turn, ('0x' || substring(md5(w), 1, 6))::bigint % 64 k, count(*) n
      from t where w <> '' group by all)
select conv_id, turn, k, round(n / sqrt(sum(n * n) over (partition by conv_id, turn)), 6) v from b""")
def q_embed_hashing(spark, sf):
    """Feature-hash vectors in long form (non-zero buckets)."""
    c = conversations_as_messages(spark, sf)
    return embed_hashing_long(c, ["conv_id", "turn"], "content")


def _event_messages(spark, sf):
    """Events as canonical messages with derived lists: a reaction when value > 25, the author
    mentioned on clicks, an attachment on purchases."""
    e = events_as_messages(spark, sf)
    att = F.when(F.col("channel_id") == "purchase",
                 F.array(F.struct(F.col("id").cast("string").alias("id"), F.lit("receipt.png").alias("filename"),
                                  F.lit(25000).cast("bigint").alias("size"), F.lit("").alias("url"),
                                  F.lit("").alias("proxy_url"), F.lit(512).alias("width"), F.lit(512).alias("height"),
                                  F.lit("image/png").alias("content_type")))) \
        .otherwise(F.array().cast("array<struct<id:string,filename:string,size:bigint,url:string,proxy_url:string,"
                                  "width:int,height:int,content_type:string>>"))
    reac = F.when(F.col("value") > 25, F.array(F.struct(F.lit("👍").alias("emoji"),
                                                        F.floor("value").cast("bigint").alias("count")))) \
        .otherwise(F.array().cast("array<struct<emoji:string,count:bigint>>"))
    men = F.when(F.col("channel_id") == "click", F.array(F.col("author"))).otherwise(F.array().cast("array<string>"))
    return e.select(F.col("id").cast("string").alias("id"), F.concat(F.lit("value "), F.col("value").cast("string")).alias("content"),
                    "author", F.col("timestamp").cast("timestamp").alias("timestamp"), "channel_id",
                    att.alias("attachments"), reac.alias("reactions"), men.alias("mentions"),
                    F.lit("discord").alias("source"))


_ISO_SQL = """(strftime("timestamp", '%Y-%m-%dT%H:%M:%S') ||
  case when microsecond("timestamp") % 1000000 <> 0 then '.' || lpad(cast(microsecond("timestamp") % 1000000 as varchar), 6, '0') else '' end
  || '+00:00')"""


@register("message_metadata", f"""
select cast(id as varchar) id, author, {_ISO_SQL} "timestamp", channel_id,
       channel_id = 'purchase' has_attachments, value > 25 has_reactions, channel_id = 'click' has_mentions
from {EVENTS_SQL}""")
def q_message_metadata(spark, sf):
    """The metadata stored next to each vector."""
    m = _event_messages(spark, sf)
    md = message_metadata("author", "timestamp", "channel_id", "attachments", "reactions", "mentions")
    return m.select("id", md.alias("m")).select("id", "m.*")


@register("serialize_roundtrip", f"""
select cast(id as varchar) id, author, "timestamp", channel_id, 'value ' || cast(value as varchar) content,
       case when channel_id = 'purchase' then 'receipt.png' end attachment_name,
       case when channel_id = 'purchase' then cast(25000 as bigint) end attachment_size,
       case when value > 25 then '👍' end emoji, case when value > 25 then cast(floor(value) as bigint) end reaction_count,
       case when channel_id = 'click' then author end mention, 'discord' as source
from {EVENTS_SQL}""")
def q_serialize_roundtrip(spark, sf):
    """N3 then N2: canonical -> JSON document -> canonical gives the same fields back."""
    m = _event_messages(spark, sf)
    js = serialize_messages(m)
    back = normalize_saved(js.select(F.from_json("json", RAW_MESSAGE).alias("r")).select("r.*"))
    first = {c: F.try_element_at(F.col(c), F.lit(1)) for c in ("attachments", "reactions", "mentions")}
    return back.select("id", "author", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "channel_id",
                       "content", first["attachments"]["filename"].alias("attachment_name"),
                       first["attachments"]["size"].alias("attachment_size"), first["reactions"]["emoji"].alias("emoji"),
                       first["reactions"]["count"].alias("reaction_count"), first["mentions"].alias("mention"), "source")


_FILE_JSON = ('[{"id":"\' || id || \'","filename":"receipt.png","size":25000,"url":"","proxy_url":"","width":512,'
              '"height":512,"content_type":"image/png"}]')


@register("serialize_messages", f"""
select cast(id as varchar) id, '{{"id":"' || id || '","content":"value ' || value || '","author":"' || author
       || '","timestamp":"' || {_ISO_SQL} || '","channel_id":"' || channel_id || '","attachments":'
       || case when channel_id = 'purchase' then '{_FILE_JSON}' else '[]' end || ',"reactions":'
       || case when value > 25 then '[{{"emoji":"👍","count":' || cast(floor(value) as bigint) || '}}]' else '[]' end
       || ',"mentions":' || case when channel_id = 'click' then '["' || author || '"]' else '[]' end
       || ',"source":"discord"}}' as json
from {EVENTS_SQL}""")
def q_serialize_messages(spark, sf):
    """The JSON documents themselves."""
    return serialize_messages(_event_messages(spark, sf)).select("id", "json")


def _api_json(spark, sf):
    """Conversation turns written as API message JSON: author object, mention objects (one without
    an id), a reaction whose emoji id is null."""
    c = conversations_as_messages(spark, sf)
    author = F.struct(F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.lit("_"), F.col("author")).alias("id"),
                      F.col("author").alias("username"))
    mentions = F.array(F.struct(F.col("conv_id").cast("string").alias("id"), F.lit("m").alias("username")),
                       F.struct(F.lit(None).cast("string").alias("id"), F.lit("noid").alias("username")))
    reactions = F.array(F.struct(F.struct(F.lit(None).cast("string").alias("id"), F.lit("🎉").alias("name")).alias("emoji"),
                                 F.col("turn").alias("count")))
    doc = F.struct(F.col("id").cast("string").alias("id"), F.col("content"), author.alias("author"),
                   F.concat(F.lit("2025-01-01T12:00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(".000Z")).alias("timestamp"),
                   F.col("channel_id"), mentions.alias("mentions"), reactions.alias("reactions"))
    return c.select(F.to_json(doc).alias("json"))


def normalized_api(spark, sf):
    return normalize_api(_api_json(spark, sf).select(F.from_json("json", RAW_MESSAGE).alias("r")).select("r.*"))


@register("normalize_api", f"""
select cast(id as varchar) id, content, author, 'u' || cast(conv_id as varchar) || '_' || author author_id,
       timestamp '2025-01-01 12:00:00' + to_seconds(turn) "timestamp", channel_id,
       cast(conv_id as varchar) mention0, cast(1 as integer) n_mentions, '🎉' emoji0, turn reaction_count0, 'discord' source
from {CONV_SQL}""")
def q_normalize_api(spark, sf):
    """API JSON -> canonical (author name from the object, mention ids, flattened reactions)."""
    n = normalized_api(spark, sf)
    return n.select("id", "content", "author", "author_id",
                    F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "channel_id",
                    F.col("mentions")[0].alias("mention0"), F.size("mentions").alias("n_mentions"),
                    F.col("reactions")[0]["emoji"].alias("emoji0"), F.col("reactions")[0]["count"].alias("reaction_count0"),
                    "source")


@register("parse_chat_log", f"""
with l as (select conv_id, turn, author || ' (2025-01-01T12:00:' || lpad(cast(turn as varchar), 2, '0') || 'Z): ' || content log
           from {CONV_SQL}),
s as (select conv_id, turn, unnest(string_split(regexp_replace(log, '^\\s+|\\s+$', '', 'g'), chr(10))) line,
             unnest(range(len(string_split(regexp_replace(log, '^\\s+|\\s+$', '', 'g'), chr(10))))) i from l)
select conv_id, turn, cast(i as varchar) id,
       regexp_replace(case when starts_with(regexp_extract(line, '^([^(]*)\\(([^)]*)\\)(.*)$', 3), ':')
                      then substring(regexp_extract(line, '^([^(]*)\\(([^)]*)\\)(.*)$', 3), 2)
                      else regexp_extract(line, '^([^(]*)\\(([^)]*)\\)(.*)$', 3) end, '^\\s+|\\s+$', '', 'g') content,
       regexp_replace(regexp_extract(line, '^([^(]*)\\(([^)]*)\\)(.*)$', 1), '^\\s+|\\s+$', '', 'g') author,
       regexp_replace(regexp_extract(line, '^([^(]*)\\(([^)]*)\\)(.*)$', 2), '^\\s+|\\s+$', '', 'g') "timestamp",
       '' channel_id
from s where regexp_matches(line, '^([^(]*)\\(([^)]*)\\)(.*)$')""")
def q_parse_chat_log(spark, sf):
    """Each turn rendered as ``role (timestamp): text`` (continuation lines included), parsed back."""
    c = conversations_as_messages(spark, sf)
    log = F.concat(F.col("author"), F.lit(" (2025-01-01T12:00:"), F.lpad(F.col("turn").cast("string"), 2, "0"),
                   F.lit("Z): "), F.col("content"))
    p = parse_chat_log(c.select("conv_id", "turn", log.alias("log")), "log", keep_cols=("conv_id", "turn"))
    return p.select("conv_id", "turn", "id", "content", "author", "timestamp", "channel_id")


@register("encrypt_roundtrip", "select conv_id, turn, role, text from conversations")
def q_encrypt_roundtrip(spark, sf):
    """AES-GCM encrypt the JSON of (role, text), decrypt, parse: the rows come back."""
    from parley.plans.tables import table
    c = table(spark, sf, "conversations")
    enc = encrypt_rows(c, ["role", "text"], ROUNDTRIP_KEY, keep=["conv_id", "turn"])
    return decrypt_rows(enc, ROUNDTRIP_KEY, "role string, text string", keep=["conv_id", "turn"])


@register("validate_source", f"""
select id, source, source in ('discord', 'slack', 'custom') valid from
(select id, case author when 'user' then 'discord' when 'assistant' then 'slack' else 'irc' end source from {CONV_SQL})""")
def q_validate_source(spark, sf):
    """sources outside the enum are routed to the rejects frame."""
    c = conversations_as_messages(spark, sf)
    m = c.select("id", F.when(F.col("author") == "user", "discord").when(F.col("author") == "assistant", "slack")
                 .otherwise("irc").alias("source"))
    ok, bad = validate_source(m)
    return ok.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


@register("embed_plugin", f"""
select conv_id, turn,
       round(((ord(substring(rpad(content, 4, ' '), 1, 1)) % 10)::double * 0.1::double)::float::double, 6) e1,
       round(((ord(substring(rpad(content, 4, ' '), 2, 1)) % 10)::double * 0.1::double)::float::double, 6) e2,
       round(((ord(substring(rpad(content, 4, ' '), 3, 1)) % 10)::double * 0.1::double)::float::double, 6) e3,
       round(((ord(substring(rpad(content, 4, ' '), 4, 1)) % 10)::double * 0.1::double)::float::double, 6) e4
from {CONV_SQL}""")
def q_embed_plugin(spark, sf):
    """A user encoder through the plug-in (iterator pandas UDF, encoder built once per worker,
    batches of 100 texts); here the reference's test encoder, so its output is known exactly."""
    from parley.operators.embed import FirstCharsEncoder, embed
    c = conversations_as_messages(spark, sf)
    e = embed(c, FirstCharsEncoder, "content", batch=100)
    # the plug-in returns float32 vectors; compare the double values the test encoder produces
    return e.select("conv_id", "turn", *[F.round(F.col("embedding")[i].cast("double"), 6).alias(f"e{i + 1}")
                                         for i in range(4)])
