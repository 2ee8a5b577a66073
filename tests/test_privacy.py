"""Redaction patterns, chain order, custom patterns, opt-out and registry operations."""

import pytest

from parley.functions import redact as R
from parley.operators.privacy import (apply_privacy, audit_pii, drop_empty_content, exclude_opted_out, optout_add,
                                      optout_membership, optout_remove)


def _red(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return [r[0] for r in df.orderBy("id").select(R.redact_pii("t", **kw)).collect()]


CASES = [
    ("mail me at john.doe@example.com now", "mail me at [EMAIL REDACTED] now"),
    ("call 555-123-4567 today", "call [PHONE REDACTED] today"),
    ("ssn 123-45-6789", "ssn [SSN REDACTED]"),
    ("host 192.168.1.20 down", "host [IP REDACTED] down"),
    ("card 4111-1111-1111-1111", "card [CREDIT CARD REDACTED]"),
    ("card 4111111111111111", "card [CREDIT CARD REDACTED]"),
    ("a@b.io and 10.0.0.1", "[EMAIL REDACTED] and [IP REDACTED]"),
    ("", ""),
    ("no personal data here", "no personal data here"),
    ("UPPER@EXAMPLE.ORG", "[EMAIL REDACTED]"),
    # Arabic-Indic digits are digits for the pattern language of the original (Unicode \\d)
    ("٥٥٥-١٢٣-٤٥٦٧", "[PHONE REDACTED]"),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_default_chain(spark, text, expected):
    assert _red(spark, [text]) == [expected]


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(R.redact_pii("t")).first()[0] is None


def test_order_matters_phone_before_ssn(spark):
    # 10 digits with separators 3-3-4 is a phone; 3-2-4 is an SSN
    assert _red(spark, ["555.123.4567 and 123-45-6789"]) == ["[PHONE REDACTED] and [SSN REDACTED]"]


def test_added_pattern_with_group_reference(spark):
    p = R.Pattern("secret", r'(token\s*=\s*)"[0-9a-f]+"', r'\1"[SECRET REDACTED]"')
    assert _red(spark, ['token = "abc123"'], added=[p]) == ['token = "[SECRET REDACTED]"']


def test_replaced_patterns(spark):
    only_ip = [R.DEFAULT_PATTERNS[3]]
    assert _red(spark, ["a@b.io 1.2.3.4"], patterns=only_ip) == ["a@b.io [IP REDACTED]"]


def test_dollar_in_replacement_is_literal(spark):
    p = R.Pattern("money", r"\bUSD\b", "$$$")
    assert _red(spark, ["pay USD"], patterns=[p]) == ["pay $$$"]


def test_python_regex_parity(spark):
    import re
    texts = ["x john@ex.com y 555-123-4567 z 1.2.3.4 w 1234 5678 9012 3456 v 123-45-6789",
             "écrire à marie@exemple.fr ou 01.23.45.67"]
    out = _red(spark, texts)
    for t, o in zip(texts, out):
        ref = t
        for p in R.DEFAULT_PATTERNS:
            ref = re.compile(p.regex, re.IGNORECASE).sub(p.replacement, ref)
        assert o == ref


def test_drop_empty_content(spark):
    df = spark.createDataFrame([("1", "Test message"), ("2", ""), ("3", None), ("4", "  ")], "id string, content string")
    assert sorted(r.id for r in drop_empty_content(df).collect()) == ["1", "4"]


def test_opt_out_author_or_id(spark):
    df = spark.createDataFrame([("1", "alice", "10"), ("2", "bob", "20"), ("3", None, None), ("4", "carol", "30")],
                               "id string, author string, author_id string")
    reg = spark.createDataFrame([("alice",), ("30",)], "user_id string")
    got = sorted(r.id for r in exclude_opted_out(df, reg, author_id_col="author_id").collect())
    assert got == ["2", "3"]


def test_apply_privacy_flags_changes(spark):
    df = spark.createDataFrame([("1", "u", "x@y.com"), ("2", "v", "plain")], "id string, author string, content string")
    out = {r.id: (r.content, r.changed) for r in apply_privacy(df, changed_col="changed").collect()}
    assert out == {"1": ("[EMAIL REDACTED]", True), "2": ("plain", False)}


def test_registry_ops(spark):
    reg = spark.createDataFrame([("a",), ("b",)], "user_id string")
    add = spark.createDataFrame([("b",), ("c",)], "user_id string")
    assert sorted(r[0] for r in optout_add(reg, add).collect()) == ["a", "b", "c"]
    rm = spark.createDataFrame([("a",), ("z",)], "user_id string")
    assert sorted(r[0] for r in optout_remove(reg, rm).collect()) == ["b"]
    assert dict(optout_membership(reg, rm).collect()) == {"a": True, "z": False}


def test_redaction_is_idempotent_and_audit_clean(spark):
    from conftest import SF_SMALL
    from parley.plans.tables import documents_as_messages
    d = documents_as_messages(spark, SF_SMALL)
    once = d.select("id", R.redact_pii("content").alias("content"))
    twice = once.select("id", R.redact_pii("content").alias("content"))
    assert once.exceptAll(twice).count() == 0
    after = {r.pattern_type: r.rows_matching for r in audit_pii(once).collect()}
    assert all(v == 0 for v in after.values())
