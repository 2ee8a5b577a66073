"""Message privacy: empty-content drop, opt-out exclusion, redaction, registry set operations, audit."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.redact import Pattern, has_required, matches, redact_pii, resolve_patterns


def drop_empty_content(df: DataFrame, content_col: str = "content") -> DataFrame:
    """drop null or '' content; whitespace-only text stays."""
    c = F.col(content_col)
    return df.filter(c.isNotNull() & (c != F.lit("")))


def exclude_opted_out(df: DataFrame, optout: DataFrame, author_col: str = "author",
                      author_id_col: str | None = None, user_col: str = "user_id") -> DataFrame:
    """Drop rows whose author (or author id) is in the opt-out registry. Null authors survive.

    Two ``left_anti`` joins rather than one OR condition, so both stay equi-joins. Adaptive execution broadcasts the
    registry if its measured bytes are small, and splits the messages of a very frequent author otherwise.
    """
    reg = optout.select(F.col(user_col).cast("string").alias("_optout")).distinct()
    out = df.join(reg, F.col(author_col).cast("string") == F.col("_optout"), "left_anti")
    if author_id_col:
        out = out.join(reg, F.col(author_id_col).cast("string") == F.col("_optout"), "left_anti")
    return out


def apply_privacy(df: DataFrame, optout: DataFrame | None = None, *, content_col: str = "content",
                  author_col: str = "author", author_id_col: str | None = None,
                  patterns: Sequence[Pattern | dict | tuple] | None = None,
                  added: Iterable[Pattern | dict | tuple] = (), redact: bool = True,
                  changed_col: str | None = None) -> DataFrame:
    """Opt-out drop, then redaction of the content if enabled; other fields untouched.

    The registry names users by name or by id: a column ``author_id``, if there, is compared as well.
    """
    if author_id_col is None and "author_id" in df.columns:
        author_id_col = "author_id"
    out = exclude_opted_out(df, optout, author_col, author_id_col) if optout is not None else df
    if redact:
        # the chain is evaluated once into a column; the flag and the content both read it
        out = out.withColumn("_redacted", redact_pii(F.col(content_col), patterns, added))
        if changed_col:
            out = out.withColumn(changed_col, F.coalesce(F.col(content_col) != F.col("_redacted"), F.lit(False)))
        out = out.withColumn(content_col, F.col("_redacted")).drop("_redacted")
    elif changed_col:
        out = out.withColumn(changed_col, F.lit(False))
    return out


def optout_add(registry: DataFrame, users: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Idempotent add."""
    return registry.select(user_col).unionByName(users.select(user_col)).distinct()


def optout_remove(registry: DataFrame, users: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Registry without the given users."""
    return registry.select(user_col).distinct().join(users.select(user_col).distinct(), user_col, "left_anti")


def optout_membership(registry: DataFrame, users: DataFrame, user_col: str = "user_id") -> DataFrame:
    """U2 report: for each user asked to be removed, whether it was in the registry."""
    reg = registry.select(user_col).distinct().withColumn("present", F.lit(True))
    return users.select(user_col).distinct().join(reg, user_col, "left") \
        .select(user_col, F.coalesce("present", F.lit(False)).alias("present"))


def audit_pii(df: DataFrame, content_col: str = "content",
              patterns: Sequence[Pattern | dict | tuple] | None = None,
              added: Iterable[Pattern | dict | tuple] = ()) -> DataFrame:
    """P10: per pattern type, rows matching before redaction and after the whole chain.

    One scan, one aggregate row per pattern (stacked), partial aggregation only: no shuffle of rows.
    """
    pats = resolve_patterns(patterns, added)
    both = df.select(F.col(content_col).alias("_raw"), redact_pii(F.col(content_col), patterns, added).alias("_red"))
    # necessary conditions, once per row on the raw text (redaction never adds '@' or digits it
    # did not find); a pattern whose condition fails cannot match either text
    flag = {"@": "_has_at", "digit": "_has_digit"}
    needs = sorted({p.requires for p in pats} & set(flag))
    pre = {k: F.col(flag[k]) for k in needs}
    both = both.select("*", *[has_required(F.col("_raw"), k).alias(flag[k]) for k in needs])
    safe = all("@" not in p.replacement and not any(ch.isdigit() for ch in p.replacement) for p in pats)

    def hit(col, p):
        m = matches(F.col(col), p)
        if p.requires in pre and (col == "_raw" or safe):
            m = pre[p.requires] & m  # And short-circuits: the regex runs only where it can match
        return m

    aggs = []
    for i, p in enumerate(pats):
        aggs.append(F.sum(hit("_raw", p).cast("long")).alias(f"b{i}"))
        aggs.append(F.sum(hit("_red", p).cast("long")).alias(f"a{i}"))
    row = both.agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(p.type).alias("pattern_type"),
                 F.coalesce(F.col(f"b{i}"), F.lit(0)).alias("rows_matching"),
                 F.coalesce(F.col(f"a{i}"), F.lit(0)).alias("rows_matching_after"))
        for i, p in enumerate(pats)]))
    return row.select(stacked.alias("s")).select("s.*")
