import hashlib
import random

import numpy as np

from helpers import empty, messy, messy_rows, prose
from parley.llm.fingerprints import M2, OrderMinHash, code_points, hexed, kmers, likeness, mixed, neighbour_fingerprints, M1


def naive(omh, text):
    h = kmers(code_points(text), omh.k)
    if not len(h):
        return np.zeros(len(omh.factors), np.uint32)
    seen, codes = {}, []
    for x in h.tolist():
        n = seen.get(x, 0)
        seen[x] = n + 1
        codes.append((int(mixed(np.array([(x + n * int(M2)) % 2 ** 64], np.uint64))[0]) if n else x) >> 32)
    out = []
    for f in omh.factors.tolist():
        places = sorted(i for _, i in sorted((c * f % 2 ** 32, i) for i, c in enumerate(codes))[:2])
        a, b = h[places[:1]], h[places[-1:]]
        out.append(int((mixed(a * M1 + mixed(b)) >> np.uint64(32))[0]))
    return np.array(out, np.uint32)


def test_selection_equals_naive():
    rng, omh = random.Random(2), OrderMinHash()
    for t in range(120):
        n = rng.choice([0, 1, 3, 7, 8, 9, 10, 30, 200, 9000 if t % 40 == 0 else 50])
        letters = rng.choice(["a", "ab", "abcdé ", "abcdefghijklmnop"])
        s, e = ("".join(rng.choice(letters) for _ in range(m)) for m in (n, rng.randint(0, 20)))
        cut, p = n - n // 3, code_points(s)
        a, b = omh.signatures(p[:cut], [p[cut:], code_points(e)])
        assert (a == naive(omh, s)).all() and (b == naive(omh, s[:cut] + e)).all()
        assert (a == omh.signature(s)).all()


def test_order_counts():
    omh = OrderMinHash()
    a, b = prose(1, 300), prose(2, 300)
    assert likeness(omh.signature(a + b), omh.signature(b + a)) < 0.9
    assert likeness(omh.signature(a), omh.signature(a[:1000] + "x" + a[1000:])) > 0.5


def brute(rows):
    omh = OrderMinHash()
    rows = [(r[0], r[1] or "") for r in rows]
    out = []
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        edited = t[:len(t) - n] + other[:n]
        s, e, o = (naive(omh, x) for x in (t, edited, other))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(s), hexed(e), likeness(s, e), likeness(s, o)))
    return out


def test_neighbours_equal_brute_force(spark):
    by_id = sorted((r for r in messy_rows() if r[0] is not None), key=lambda r: -r[0])
    rows = [r for r in by_id if len(r[1] or "") < 20_000]
    df = messy(spark).where("doc_id is not null and coalesce(length(text), 0) < 20000")
    for ranges in (1, 3, 7):
        got = [tuple(r) for r in neighbour_fingerprints(df, ranges=ranges).collect()]
        assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_null_ids_ties_one_row_and_empty(spark):
    df = messy(spark)
    got = neighbour_fingerprints(df, ranges=4).collect()
    assert len(got) == len(messy_rows())
    same = [r for r in got if r.doc_id == 2]
    assert same[0].fingerprint == same[1].fingerprint
    one = neighbour_fingerprints(df.where("doc_id = 10"), ranges=3).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(10, 1.0)]
    assert neighbour_fingerprints(empty(spark)).count() == 0


def test_text_ids(spark):
    ids = ["b", "a", "", "ß", "\U0001f600", "aa", "B", None, "10", "9"]
    rows = [(i, prose(k, 30 + k)) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0], reverse=True)
    want = brute([*named, (None, rows[7][1])])  # no id comes last
    for ranges in (1, 4):
        got = [tuple(r) for r in neighbour_fingerprints(df, ranges=ranges).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
