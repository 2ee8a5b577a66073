"""PII redaction as native column expressions.

A redaction chain is an ordered list of ``(type, regex, replacement)``; applying it is a left fold of
``regexp_replace`` over one column, so the whole chain stays inside whole-stage codegen and each
constant pattern is compiled once per task.

Regex dialect: patterns are written in Python syntax. Java needs ``(?U)`` to give ``\\d``, ``\\b``
and ``\\s`` the Unicode meaning they have in Python (Arabic-Indic digits are digits), and ``(?i)``
for the case-insensitive matching of the original. Python replacement templates (``\\1``,
``\\g<name>``) are translated to Java's (``$1``, ``${name}``); a literal ``$`` is escaped.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    type: str
    regex: str
    replacement: str
    # a character class every match contains ("@" or "digit"); None when unknown (custom patterns)
    requires: str | None = None


# The default redaction patterns, in application order (email, phone, ssn, ip,
# credit card). They must stay verbatim, including the literal '|' inside the email TLD class.
DEFAULT_PATTERNS: tuple[Pattern, ...] = (
    Pattern("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL REDACTED]", "@"),
    Pattern("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE REDACTED]", "digit"),
    Pattern("ssn", r"\b\d{3}[-]?\d{2}[-]?\d{4}\b", "[SSN REDACTED]", "digit"),
    Pattern("ip", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP REDACTED]", "digit"),
    Pattern("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "[CREDIT CARD REDACTED]", "digit"),
)

JAVA_FLAGS = "(?iU)"

_SIMPLE_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "b": "\b", "\\": "\\"}


def java_replacement(py_repl: str) -> str:
    """Translate a Python ``re.sub`` template into a Java ``Matcher.replaceAll`` one."""
    out, i = [], 0
    while i < len(py_repl):
        ch = py_repl[i]
        if ch == "$":
            out.append("\\$")
        elif ch == "\\" and i + 1 < len(py_repl):
            nxt = py_repl[i + 1]
            m = re.match(r"\\g<(\w+)>", py_repl[i:])
            if m:
                name = m.group(1)
                out.append("$" + name if name.isdigit() else "${" + java_name(name) + "}")
                i += len(m.group(0))
                continue
            m = re.match(r"\\(0[0-7]{0,2}|[1-3][0-7]{2})", py_repl[i:])
            if m:  # an octal escape is a character, not a group
                ch = chr(int(m.group(1), 8))
                out.append("\\" + ch if ch in "$\\" else ch)
                i += len(m.group(0))
                continue
            m = re.match(r"\\([1-9]\d?)", py_repl[i:])
            if m:
                out.append("$" + m.group(1))
                i += len(m.group(0))
                continue
            lit = _SIMPLE_ESCAPES.get(nxt)
            if lit is None:  # unknown escape: Python keeps it verbatim
                out.append("\\\\" + ("\\$" if nxt == "$" else nxt))
            else:
                out.append("\\\\" if lit == "\\" else lit)
            i += 2
            continue
        elif ch == "\\":
            out.append("\\\\")
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def java_name(name: str) -> str:
    """Java's group names have letters and digits only."""
    return name if re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", name) else "g" + "".join(
        c if c.isascii() and c.isalnum() else f"x{ord(c):x}" for c in name)


def java_regex(py_regex: str) -> str:
    """Python's named groups and references to them in Java's spelling (outside of escapes)."""
    def named(m: re.Match) -> str:
        if m.group(1):
            return m.group(1)
        return f"(?<{java_name(m.group(2))}>" if m.group(2) else f"\\k<{java_name(m.group(3))}>"

    return JAVA_FLAGS + re.sub(r"(\\.)|\(\?P<(\w+)>|\(\?P=(\w+)\)", named, py_regex, flags=re.S)


def resolve_patterns(patterns: Sequence[Pattern | dict | tuple] | None = None,
                     added: Iterable[Pattern | dict | tuple] = ()) -> list[Pattern]:
    """A non-empty ``patterns`` list replaces the defaults; ``added`` patterns are appended."""

    def norm(p):
        if isinstance(p, Pattern):
            return p
        if isinstance(p, dict):
            return Pattern(p["type"], p["regex"], p["replacement"])
        return Pattern(*p)

    base = [norm(p) for p in patterns] if patterns else list(DEFAULT_PATTERNS)
    return base + [norm(p) for p in added]


def redact_with(col: Column, pattern: Pattern) -> Column:
    return F.regexp_replace(col, java_regex(pattern.regex), java_replacement(pattern.replacement))


def _guard(c: Column, pats: list[Pattern]) -> Column | None:
    """A cheap test that is true for every text any pattern of the chain could change, or None.

    Exact when every pattern names a character its matches must contain and no replacement writes
    such a character (group references only copy text that was already there): a text without any
    of them passes through every step unchanged.
    """
    needs = {p.requires for p in pats}
    if not pats or None in needs or not needs <= {"@", "digit"}:
        return None
    for p in pats:
        literal = re.sub(r"\\g<\w+>|\\\d{1,2}", "", p.replacement)
        if "@" in literal or any(ch.isdigit() for ch in literal):
            return None
    tests = []
    if "@" in needs:
        tests.append(F.instr(c, "@") > 0)
    if "digit" in needs:
        tests.append(c.rlike(r"(?U)\d"))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def redact_pii(col: Column | str, patterns: Sequence[Pattern | dict | tuple] | None = None,
               added: Iterable[Pattern | dict | tuple] = ()) -> Column:
    """Every pattern in order, one after another. Null stays null, empty stays empty.

    Texts that no pattern of the chain can match (for the defaults: no '@' and no digit, most
    messages) skip the regex chain after one cheap scan.
    """
    c = F.col(col) if isinstance(col, str) else col
    pats = resolve_patterns(patterns, added)
    out = c
    for p in pats:
        out = redact_with(out, p)
    guard = _guard(c, pats)
    return out if guard is None else F.when(guard, out).otherwise(c)


def _by_type(kind: str) -> Pattern:
    return next(p for p in DEFAULT_PATTERNS if p.type == kind)


def has_required(col: Column | str, kind: str | None) -> Column | None:
    """Does the text contain the character a pattern's matches need ('@' or a Unicode digit)?"""
    c = F.col(col) if isinstance(col, str) else col
    if kind == "@":
        return F.instr(c, "@") > 0
    if kind == "digit":
        return c.rlike(r"(?U)\d")
    return None


def could_match(col: Column | str, pattern: Pattern) -> Column | None:
    """A cheap necessary condition for ``pattern`` to match ``col`` (None if the pattern names none)."""
    return has_required(col, pattern.requires)


def _single(col: Column | str, pattern: Pattern) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    guard = could_match(c, pattern)
    out = redact_with(c, pattern)
    return out if guard is None else F.when(guard, out).otherwise(c)


def redact_email(col: Column | str) -> Column:
    return _single(col, _by_type("email"))


def redact_phone(col: Column | str) -> Column:
    return _single(col, _by_type("phone"))


def redact_ssn(col: Column | str) -> Column:
    return _single(col, _by_type("ssn"))


def redact_ip(col: Column | str) -> Column:
    return _single(col, _by_type("ip"))


def redact_credit_card(col: Column | str) -> Column:
    return _single(col, _by_type("credit_card"))


def redaction_changed(original: Column | str, redacted: Column | str) -> Column:
    """Did redaction alter the text (null text: false)."""
    o = F.col(original) if isinstance(original, str) else original
    r = F.col(redacted) if isinstance(redacted, str) else redacted
    return F.coalesce(o != r, F.lit(False))


def matches(col: Column | str, pattern: Pattern) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.rlike(java_regex(pattern.regex))
