"""Column functions for chat messages: timestamps, authors, mentions, reactions, metadata, JSON.

All native Catalyst expressions (higher-order functions, JSON/variant functions); no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCES = ("discord", "slack", "custom")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_ts(col) -> Column:
    """ISO-8601 text to timestamp; ``Z`` and offsets honoured, fractions kept, naive = UTC (session
    time zone), anything unparseable is null rather than an error. The basic form (``20250101T120000Z``) is read too;
    a time without a date is no timestamp."""
    c = F.trim(_c(col).cast("string"))
    basic = r"^(\d{4})(\d{2})(\d{2})(?:[T ](\d{2})(\d{2})(\d{2})(\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?$"
    full = F.regexp_replace(c, basic, "$1-$2-$3T$4:$5:$6$7$8")
    full = F.when(c.rlike(r"^\d{8}$"), F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(full)
    full = F.regexp_replace(full, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(full.rlike(r"^[+-]?\d{4,}-"), full.try_cast("timestamp"))


def iso_ts(col) -> Column:
    """Timestamp as ISO-8601 text in UTC, e.g. ``2025-01-01T12:00:00+00:00``, whatever the session's zone."""
    c = F.to_utc_timestamp(_c(col).cast("timestamp"), F.current_timezone())
    frac = F.when(F.date_format(c, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(c, "SSSSSS"))) \
        .otherwise(F.lit(""))
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), frac, F.lit("+00:00"))


def _is_obj(c: Column) -> Column:
    return F.ltrim(c).startswith("{")


def author_name(col) -> Column:
    """Author given as JSON object text (``username``) or as a plain string; else 'unknown'."""
    c = _c(col)
    from_obj = F.try_variant_get(F.try_parse_json(c), "$.username", "string")
    return F.coalesce(F.when(_is_obj(c), from_obj).otherwise(c), F.lit("unknown"))


def author_id(col) -> Column:
    c = _c(col)
    return F.when(_is_obj(c), F.try_variant_get(F.try_parse_json(c), "$.id", "string"))


def mention_ids(col) -> Column:
    """Ids of the mention objects that have one, in order (JSON text of an array of objects or
    strings); plain strings are taken as ids; missing = empty."""
    arr = F.from_json(_c(col), "array<string>")

    def one(m):
        return F.when(m.startswith("{"), F.get_json_object(m, "$.id")).otherwise(m)

    ids = F.transform(arr, one)
    return F.coalesce(F.filter(ids, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def flatten_reactions(col) -> Column:
    """``(emoji name or '', count or 0)`` per reaction, in order; missing = empty. The emoji is JSON text of an
    object with a name (API messages) or the name itself (saved messages)."""
    def one(r):
        e = r["emoji"]
        name = F.when(_is_obj(e), F.try_variant_get(F.try_parse_json(e), "$.name", "string")).otherwise(e)
        return F.struct(F.coalesce(name, F.lit("")).alias("emoji"),
                        F.coalesce(r["count"], F.lit(0).cast("bigint")).alias("count"))

    return F.coalesce(F.transform(_c(col), one), F.array().cast("array<struct<emoji:string,count:bigint>>"))


def valid_source(col) -> Column:
    """one of the three known sources."""
    return _c(col).isin(*SOURCES)


def message_metadata(author, ts, channel, attachments, reactions, mentions) -> Column:
    """Author, ISO timestamp, channel and three has-flags (list length > 0)."""
    def has(x):
        return F.coalesce(F.size(_c(x)) > 0, F.lit(False))

    return F.struct(_c(author).alias("author"), iso_ts(ts).alias("timestamp"), _c(channel).alias("channel_id"),
                    has(attachments).alias("has_attachments"), has(reactions).alias("has_reactions"),
                    has(mentions).alias("has_mentions"))


def embed_test(col) -> Column:
    """First 4 characters, right-padded with blanks; each ``(code point % 10) * 0.1``."""
    padded = F.rpad(F.coalesce(_c(col), F.lit("")), 4, " ")
    return F.transform(F.sequence(F.lit(1), F.lit(4)),
                       lambda i: (F.ascii(F.substring(padded, i, 1)) % 10).cast("double") * F.lit(0.1))


def truncate_display(col, width: int = 100) -> Column:
    """Longer than ``width`` -> first ``width - 3`` characters and '...'."""
    c = _c(col)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)
