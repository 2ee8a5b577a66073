import random
from itertools import combinations

import numpy as np
import xxhash

from helpers import empty, messy, messy_rows
from parley.llm.simhash import block_masks, components, fingerprint, links, near_duplicates, one_of_each_group, tile_links


def brute_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in t.encode().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ")
             .replace(b"\r", b" ").split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_messy_documents(spark):
    rows = messy_rows()
    fps = [brute_fingerprint(r[1] or "") for r in rows]
    groups = brute_groups(fps)
    want = []
    for r, fp, g in zip(rows, fps, groups):
        ids = [x[0] for x, k in zip(rows, groups) if k == g and x[0] is not None]
        want.append((r[0], f"{fp:016x}", min(ids) if ids else None))
    got = [tuple(r) for r in near_duplicates(messy(spark)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_stage_keeps_one_of_each_group(spark):
    df = messy(spark)
    kept = one_of_each_group(df)
    assert kept.columns == df.columns
    rows = messy_rows()
    groups = brute_groups([brute_fingerprint(r[1] or "") for r in rows])
    ids = sorted((min((r[0] is None, r[0] or 0) for r, k in zip(rows, groups) if k == g) for g in set(groups)))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == ids


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).count() == 0
    assert one_of_each_group(empty(spark)).count() == 0


def test_tiles_find_all_pairs():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(20)} | {0, (1 << 64) - 1})
    a, b = tile_links(np.array(fps, np.uint64), 2, tile=16)
    got = {frozenset(p) for p in zip(a.tolist(), b.tolist())}
    assert got == {frozenset(p) for p in combinations(fps, 2) if (p[0] ^ p[1]).bit_count() <= 2}


def test_every_close_pair_shares_a_key():
    rng = random.Random(6)
    masks = block_masks(2, 8)
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert any(x & m == y & m for m in masks)


def test_links_and_components_over_chains(spark):
    chain = [0]
    for i in range(40):  # each within two bits of the one before only
        chain.append(chain[-1] ^ (3 << (i % 32) * 2))
    signed = [c - (1 << 64) if c >> 63 else c for c in dict.fromkeys(chain)]
    far = 0x5555555555555555
    fps = spark.createDataFrame([(c,) for c in [*signed, far]], "fp bigint")
    got = {r.node: r.root for r in components(links(fps)).collect()}
    want = brute_groups([c & ((1 << 64) - 1) for c in signed])
    assert set(want) == {0}
    assert {got[c] for c in signed if c in got} == {min(signed)}
    assert far not in got


def test_fingerprint_of_edge_texts():
    for t in ["", " \t", "one", "one two", "Ä b C d", "a\u00a0b c", "A" * 10000]:
        assert fingerprint(t.encode()) == brute_fingerprint(t), t
