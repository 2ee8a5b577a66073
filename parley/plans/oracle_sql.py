"""SQL fragments for the DuckDB oracles, built from the same fixed values as the Spark side."""

from __future__ import annotations

from parley.functions.redact import DEFAULT_PATTERNS, Pattern
from parley.plans.registry import sql_str


def redact_sql(col: str, p: Pattern) -> str:
    # DuckDB (RE2) takes the Python-style template as is: \1 is group 1
    return f"regexp_replace({col}, {sql_str(p.regex)}, {sql_str(p.replacement)}, 'gi')"


def chain_sql(col: str, patterns) -> str:
    out = col
    for p in patterns:
        out = redact_sql(out, p)
    return out


def matches_sql(col: str, p: Pattern) -> str:
    return f"regexp_matches({col}, {sql_str(p.regex)}, 'i')"


def default_chain_sql(col: str) -> str:
    return chain_sql(col, DEFAULT_PATTERNS)
