import random
import re

from helpers import SCHEMA, empty, messy, messy_rows, prose
from parley.llm.quality import QualityRules, base_counts, good_documents, quality_verdicts, without_lines, line_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULES = QualityRules(min_words=5, min_docs=2, host_share=0.2, min_kept_share=0.3)


def brute_base(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(again)


def norm(line):
    return " ".join(WORD.findall(line.lower()))


def brute(rows, rules):
    texts = {}
    for r in rows:
        texts.setdefault(r[3] or "", set()).add(r[1] or "" if r[1] is not None else None)
    often = {}
    for host, some in texts.items():
        counts = {}
        for t in some:
            for x in {norm(x) for x in (t or "").split("\n")} - {""}:
                counts[x] = counts.get(x, 0) + 1
        often[host] = {x for x, n in counts.items() if n > rules.min_docs and n > rules.host_share * len(some)}
    out = []
    for r in rows:
        base = brute_base(r[1] or "")
        gone = sum(len(norm(x).split(" ")) for x in (r[1] or "").split("\n") if norm(x) in often[r[3] or ""])
        failed = base[0] < rules.min_words or 100 * base[4] > rules.max_repeat_percent * base[0]
        out.append((r[0], *base, gone, failed, not failed and base[0] - gone >= rules.min_kept_share * base[0]))
    return out, often


def corpus():
    rng = random.Random(2)
    common = ["Home | About  us", "home | about us", "All rights reserved, #1 & more"]
    rows = []
    for i in range(60):
        lines = [prose(100 + i, rng.randint(3, 12)) for _ in range(rng.randint(0, 3))] + [rng.choice(common) for _ in range(rng.randint(0, 3))]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "en", rng.choice(["a", "a", "b"]), 1))
    rows += [(200 + i, prose(7, 20) + "\nonly copies", "en", "a", 1) for i in range(30)]  # exact copies are one document
    rows += [(300, "la la la la la la la la", "en", "b", 1)]
    return rows + [r for r in messy_rows() if r[0] != 6]


def test_verdicts_equal_brute_force(spark):
    rows = corpus()
    got = [tuple(r) for r in quality_verdicts(spark.createDataFrame(rows, SCHEMA), rules=RULES).collect()]
    want, often = brute(rows, RULES)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(often.values()) and {r[-1] for r in want} == {True, False}


def test_stage_drops_documents_and_lines(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    want, often = brute(rows, RULES)
    keep = []
    for r, w in zip(rows, want):
        if w[-1]:
            text = "\n".join(x for x in r[1].split("\n") if norm(x) not in often[r[3] or ""])
            keep.append((r[0], text, r[2], r[3], len(text) if text != r[1] else r[4]))
    assert sorted(map(tuple, good_documents(df, rules=RULES).collect()), key=repr) == sorted(keep, key=repr)


def test_messy_and_empty(spark):
    df = messy(spark)
    rows = {(r.doc_id, r.n_words): r for r in quality_verdicts(df).collect()}
    assert not rows[(3, 0)].kept and rows[(3, 0)].base_failed
    assert rows[(6, 6000)].kept
    assert good_documents(df).columns == df.columns
    assert quality_verdicts(empty(spark)).count() == 0 and good_documents(empty(spark)).count() == 0


def test_base_counts():
    for t in ["", "a", "a b c a b c", "x\n\nx\n x\nx", "a b c d", "## a * b", prose(1, 300), "la " * 50, "é è\x0bê"]:
        assert base_counts(t) == brute_base(t), t


def test_lines_are_removed_by_their_normal_form():
    h = line_hash(b"home page".split())
    assert without_lines("x\nHome  PAGE \n\ny", {h}) == "x\n\ny"


def test_a_line_in_many_documents_is_frequent_in_a_large_host(spark):
    rows = [(i, prose(900 + i, 60) + ("\nall rights reserved" if i < 9 else ""), "en", "a", 1) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.removed_words for r in quality_verdicts(df).collect()} == {0}  # 9 of 200 is under the share
    got = {r.doc_id: r for r in quality_verdicts(df, rules=QualityRules(max_docs=8)).collect()}
    assert all(r.kept and r.removed_words == (3 if i < 9 else 0) for i, r in got.items())
    texts = {r.doc_id: r.text for r in good_documents(df, rules=QualityRules(max_docs=8)).collect()}
    assert texts == {i: t.split("\n")[0] for i, t, *_ in rows}
