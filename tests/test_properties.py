"""Property tests: many random cases per Spark job (hypothesis draws lists, one job per example)."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from parley.functions import redact as R
from parley.sources.chatlog import parse_chat_log

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

# realistic message characters: ASCII, precomposed accented letters, Arabic-Indic digits, separators
ALPHABET = st.sampled_from(list("abcXYZ0123456789 .-@_%+|\t\n") + ["é", "ß", "ü", "٣", "٧", "1.2", "555-", ".com"])
TEXT = st.lists(ALPHABET, max_size=40).map("".join)


def _python_chain(text):
    for p in R.DEFAULT_PATTERNS:
        text = re.compile(p.regex, re.IGNORECASE).sub(p.replacement, text)
    return text


@SETTINGS
@given(st.lists(TEXT, min_size=30, max_size=60))
def test_redaction_equals_python_re(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(R.redact_pii("t")).collect()]
    assert got == [_python_chain(t) for t in texts]
    again = spark.createDataFrame([(i, t) for i, t in enumerate(got)], "i int, t string")
    assert [r[0] for r in again.orderBy("i").select(R.redact_pii("t")).collect()] == [_python_chain(t) for t in got]


def _rule(text):
    """The S2 rule written out: strip, split on newlines, keep lines with '(' and a later ')'."""
    out = []
    for i, line in enumerate(text.strip().split("\n")):
        a = line.find("(")
        if a < 0:
            continue
        b = line.find(")", a + 1)
        if b < 0:
            continue
        rest = line[b + 1:]
        content = rest[1:].strip() if rest.startswith(":") else rest.strip()
        out.append((str(i), line[:a].strip(), line[a + 1:b].strip(), content))
    return out


LOG_CHARS = st.sampled_from(list("ab (): \t\r") + ["\n", "user", "12:00", "))", "(("])
LOG = st.lists(LOG_CHARS, max_size=30).map("".join)


@SETTINGS
@given(st.lists(LOG, min_size=20, max_size=40))
def test_chat_log_rule(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    rows = parse_chat_log(df, "text", keep_cols=("k",)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.k, []).append((r.id, r.author, r.timestamp, r.content))
    for k, t in enumerate(texts):
        assert sorted(got.get(k, []), key=lambda x: int(x[0])) == _rule(t), repr(t)


def test_breaker_batch_equals_stream(spark):
    from conftest import SF_SMALL
    from parley.plans.catalog import QUERIES
    batch = sorted(tuple(r) for r in QUERIES["breaker_replay"](spark, SF_SMALL)
                   .join(QUERIES["breaker_gate"](spark, SF_SMALL), ["user_id", "event_id"]).collect())
    stream = sorted(tuple(r) for r in QUERIES["breaker_stream"](spark, SF_SMALL)
                    .select("user_id", "event_id", "failures", "is_open", "can_execute").collect())
    assert batch == stream
