import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm.url_filters import RULES, ShiftAnd, UrlRule, url_verdicts


def glob_regex(g: bytes) -> re.Pattern:
    return re.compile(b"".join(b".*" if c == 42 else b"." if c == 63 else re.escape(bytes([c])) for c in g), re.S)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab*?", max_size=40), min_size=1, max_size=6), st.lists(st.text("ab", max_size=12), max_size=8))
def test_automaton_equals_regex(globs, texts):
    globs, raw = [g.encode() for g in globs], [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    hit = ShiftAnd(globs).matches(np.frombuffer(b"".join(raw), np.uint8), off)
    for i, t in enumerate(raw):
        for k, g in enumerate(globs):
            assert hit[i, k] == bool(glob_regex(g).fullmatch(t)), (g, t)


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


URLS = [None, "", "no scheme", "http://", "http://a.org", "http://a.org/", "https://EXAMPLE.org/es/1?x#y", "x://example.org/en/12",
        "http://example.org/en/", "http://notexample.org/es/", "http://xcom/fr/", "http://b.com/fr/x", "http://b.com/de/x",
        "http://u@b.com:80/de/", "http://b.net/x.org/y", "http://ÄB.org/ü", "http://a.org?q=/", "http://a.b.com/de/" + "z" * 9000,
        "http://com/de/*", "http://example.org/es/", "http://example.org/es/"]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, rule string")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_verdicts(df).collect()}
    assert rows == {i: brute(u) for i, u in enumerate(URLS)}


def test_no_rules_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "http://a.org/")], "page_id bigint, url string")
    assert [tuple(r) for r in url_verdicts(df, rules=[], default="block").collect()] == [(None, "a.org", "/", None, "block")]
    assert url_verdicts(df.where("false")).count() == 0


def test_many_rules_over_several_words(spark):
    rules = [UrlRule("block", f"host{i}.example", f"/{i}/") for i in range(40)] + [UrlRule("allow", "host3*", "/*secret")]
    df = spark.createDataFrame([(1, "http://www.host39.example/39/x"), (2, "http://host30.example/a/secret"), (3, "http://host.example/")],
                               "page_id bigint, url string")
    got = {r.page_id: r.rule for r in url_verdicts(df, rules=rules).collect()}
    assert got == {1: "host39.example/39/", 2: "host3*/*secret", 3: None}
