"""Queries: redaction, opt-out and registry operations on ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import redact as R
from parley.operators.privacy import (apply_privacy, audit_pii, drop_empty_content, exclude_opted_out,
                                      optout_add, optout_membership, optout_remove)
from parley.plans.oracle_sql import chain_sql, default_chain_sql, matches_sql, redact_sql
from parley.plans.registry import register, sql_str
from parley.plans.tables import CONV_SQL, DOCS_SQL, conversations_as_messages, documents_as_messages, table

# Parameters of the privacy queries (inputs a user would pass, not data subsets).
OPT_OUT = ("src3", "src7")
ADDED_USERS = ("src3", "new_user")
REMOVED_USERS = ("src3", "ghost_user")
SECRET = R.Pattern("secret", r'(token\s*=\s*)"[0-9a-f]+"', r'\1"[SECRET REDACTED]"')
REPLACED = (R.DEFAULT_PATTERNS[3], R.DEFAULT_PATTERNS[0])  # ip, then email: a user-given list


def _users(spark, names):
    return spark.createDataFrame([(n,) for n in names], "user_id string")


def _values_sql(names):
    return "(select * from (values " + ", ".join(f"({sql_str(n)})" for n in names) + ") v(user_id))"


def _single(kind: str):
    pat = next(p for p in R.DEFAULT_PATTERNS if p.type == kind)

    def q(spark, sf):
        d = documents_as_messages(spark, sf)
        return d.select("id", getattr(R, f"redact_{kind}")("content").alias("content"))

    register(f"redact_{kind}", f"select id, {redact_sql('content', pat)} content from {DOCS_SQL}")(q)


for _k in ("email", "phone", "ssn", "ip", "credit_card"):
    _single(_k)


@register("redact_pii", f"select id, {default_chain_sql('content')} content from {DOCS_SQL}")
def q_redact_pii(spark, sf):
    """The default chain, in order."""
    d = documents_as_messages(spark, sf)
    return d.select("id", R.redact_pii("content").alias("content"))


@register("redaction_changed",
          f"select id, coalesce(content <> {default_chain_sql('content')}, false) changed from {DOCS_SQL}")
def q_redaction_changed(spark, sf):
    """P9."""
    d = documents_as_messages(spark, sf)
    return d.select("id", R.redaction_changed(F.col("content"), R.redact_pii("content")).alias("changed"))


@register("redact_custom_added",
          f"select id, {chain_sql('content', list(R.DEFAULT_PATTERNS) + [SECRET])} content from {DOCS_SQL}")
def q_redact_custom_added(spark, sf):
    """An added pattern (with a group reference in its replacement) runs after the defaults."""
    d = documents_as_messages(spark, sf)
    return d.select("id", R.redact_pii("content", added=[SECRET]).alias("content"))


@register("redact_custom_replaced", f"select id, {chain_sql('content', REPLACED)} content from {DOCS_SQL}")
def q_redact_custom_replaced(spark, sf):
    """A non-empty pattern list replaces the defaults, applied in the given order."""
    d = documents_as_messages(spark, sf)
    return d.select("id", R.redact_pii("content", patterns=list(REPLACED)).alias("content"))


_AUDIT_SQL = " union all ".join(
    f"select {i} position, {sql_str(p.type)} pattern_type, "
    f"cast(sum(case when {matches_sql('content', p)} then 1 else 0 end) as bigint) rows_matching, "
    f"cast(sum(case when {matches_sql('red', p)} then 1 else 0 end) as bigint) rows_matching_after "
    f"from (select content, {default_chain_sql('content')} red from {DOCS_SQL})"
    for i, p in enumerate(R.DEFAULT_PATTERNS))


@register("audit_pii", _AUDIT_SQL)
def q_audit_pii(spark, sf):
    """P10: per pattern, documents matching before and after the chain (after should be 0)."""
    return audit_pii(documents_as_messages(spark, sf))


@register("drop_empty_content", f"select id, content from {CONV_SQL} where content is not null and content <> ''")
def q_drop_empty_content(spark, sf):
    """F2 on conversation turns."""
    return drop_empty_content(conversations_as_messages(spark, sf)).select("id", "content")


@register("exclude_opted_out",
          f"select id, author from {DOCS_SQL} where author is null or author not in (select user_id from {_values_sql(OPT_OUT)})")
def q_exclude_opted_out(spark, sf):
    """F3/J1."""
    return exclude_opted_out(documents_as_messages(spark, sf), _users(spark, OPT_OUT)).select("id", "author")


@register("apply_privacy", f"""
select id, author, {default_chain_sql('content')} content,
       coalesce(content <> {default_chain_sql('content')}, false) changed
from {DOCS_SQL} where author is null or author not in (select user_id from {_values_sql(OPT_OUT)})""")
def q_apply_privacy(spark, sf):
    """Opt-out then redaction."""
    out = apply_privacy(documents_as_messages(spark, sf), _users(spark, OPT_OUT), changed_col="changed")
    return out.select("id", "author", "content", "changed")


NAMED = R.Pattern("secret", r'(?P<key_name>token)(\s*=\s*)"(?P<digits>[0-9a-f]+)"', r'\g<key_name>\2"[\g<key_name>]"')


@register("redact_named_groups", f"""
select id, regexp_replace(content, '(token)(\\s*=\\s*)"([0-9a-f]+)"', '\\1\\2"[\\1]"', 'gi') content from {DOCS_SQL}""")
def q_redact_named_groups(spark, sf):
    """A pattern with named groups and references to them."""
    d = documents_as_messages(spark, sf)
    return d.select("id", R.redact_pii("content", patterns=[NAMED]).alias("content"))


OPT_OUT_IDS = ("u3_user", "u7_assistant")


@register("opt_out_by_id", f"""
select cast(id as varchar) id, author, 'u' || conv_id || '_' || author author_id from {CONV_SQL}
where content is not null and content <> ''
  and 'u' || conv_id || '_' || author not in (select user_id from {_values_sql(OPT_OUT_IDS)})""")
def q_opt_out_by_id(spark, sf):
    """Q3 in M4 and R2: only the user ids are in the registry, the messages carry names and ids."""
    from parley.plans.q_messages import normalized_api
    msgs = drop_empty_content(normalized_api(spark, sf))
    return apply_privacy(msgs, _users(spark, OPT_OUT_IDS), redact=False).select("id", "author", "author_id")


_REGISTRY_SQL = "(select distinct source user_id from documents)"


@register("optout_add", f"select distinct user_id from (select * from {_REGISTRY_SQL} union all select * from {_values_sql(ADDED_USERS)})")
def q_optout_add(spark, sf):
    """registry = every author seen in documents, plus two ids (one already present)."""
    reg = table(spark, sf, "documents").select(F.col("source").alias("user_id"))
    return optout_add(reg.distinct(), _users(spark, ADDED_USERS))


@register("optout_remove",
          f"select user_id from {_REGISTRY_SQL} where user_id not in (select user_id from {_values_sql(REMOVED_USERS)})")
def q_optout_remove(spark, sf):
    """U2."""
    reg = table(spark, sf, "documents").select(F.col("source").alias("user_id"))
    return optout_remove(reg, _users(spark, REMOVED_USERS))


@register("optout_membership", f"""
select r.user_id, r.user_id in (select user_id from {_REGISTRY_SQL}) present from {_values_sql(REMOVED_USERS)} r""")
def q_optout_membership(spark, sf):
    """U2 report: was each removed id present."""
    reg = table(spark, sf, "documents").select(F.col("source").alias("user_id"))
    return optout_membership(reg, _users(spark, REMOVED_USERS))
