import random

import numpy as np
import pyarrow as pa
from llm_helpers import prose

from tracewright.llm import simhash as s
from tracewright.llm.textcodes import Grams


def varied(text, n, seed):
    r = random.Random(seed)
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(["kuku", "toto", "zizi"]) + str(r.randint(0, 99))
    return " ".join(words)


def corpus():
    rows = []
    for g in range(12):
        base = prose(g, 150)
        rows += [(len(rows) + k, varied(base, k % 4, k)) for k in range(5)]
    rows += [(1000 + i, prose(5000 + i, 60 + i)) for i in range(120)]
    return rows


def test_allocation_is_the_cheapest():
    r = random.Random(4)
    for _ in range(20):
        cost = [[0.0] + sorted(r.random() * 100 for _ in range(9)) for _ in range(3)]
        best = min(sum(c[t] for c, t in zip(cost, ts, strict=True)) for ts in ((a, b, 9 - a - b) for a in range(10) for b in range(10 - a)) if max(ts) < 10)
        total, ts = s.allocate(cost, 8)
        assert abs(total - best) < 1e-9 and sum(t + 1 for t in ts) == 9


def test_groups_of_bits_are_a_partition():
    both = np.random.default_rng(1).random((64, 64))
    for m in (2, 3, 4):
        groups = s.grouped(10, (both + both.T) / 2, m)
        assert sorted(b for g in groups for b in g) == list(range(64)) and len(groups) == m


def brute(prints, tau, tau_all):
    """Pairs of (rep, a, b) within both limits, all against all."""
    out = set()
    for i, (u, a, b) in enumerate(prints):
        for v, c, d in prints[i + 1 :]:
            x, y = bin((a ^ c) & (1 << 64) - 1).count("1"), bin((b ^ d) & (1 << 64) - 1).count("1")
            if x <= tau and x + y <= tau_all:
                out.add((min(u, v), max(u, v)))
    return out


def test_pairs_are_those_of_brute_force(spark):
    r = random.Random(7)
    rows = []
    for i in range(60):
        a, b = r.getrandbits(64), r.getrandbits(64)
        for k in range(4):
            flip = sum(1 << x for x in r.sample(range(64), r.randint(0, 9)))
            rows.append((len(rows), a ^ flip, b))
    signed = [(i, a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b) for i, a, b in rows]
    signed.append((900, -(1 << 63), 0))
    signed.append((901, 0, 0))
    df = spark.createDataFrame(signed, "rep long, a long, b long")
    want = brute(signed, 8, 18)
    n, both = s.bit_stats(df)
    for m, ts in ((2, [4, 3]), (3, [2, 2, 2]), (4, [2, 1, 1, 1]), (3, [5, 2, -1])):
        plan = [(g, t) for g, t in zip(s.grouped(n, both, m), ts, strict=True) if t >= 0]
        got = [tuple(p) for p in s.near_pairs(df, plan, 8, 18).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(p) for p in s.near_pairs(df, s.plan(df, 8), 8, 18).collect()} == want


def test_large_group_of_different_copies(spark):
    """A chain of crowds: the links are few, and all that hangs together in all pairs does so by them."""
    r = random.Random(11)
    rows = []
    for c in range(3):
        a, b = r.getrandbits(64), r.getrandbits(64)
        for step in range(4):  # each crowd's centre is 8 bits from the one before
            rows += [(a ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 3))), b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 2)))) for _ in range(150 if c else 600)]
            a ^= sum(1 << (16 * step + x) for x in r.sample(range(16), 8))
    rows += [(r.getrandbits(64), r.getrandbits(64)) for _ in range(400)]
    rows = sorted(set(rows))
    signed = [(i, a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b) for i, (a, b) in enumerate(rows)]
    df = spark.createDataFrame(signed, "rep long, a long, b long").repartition(3)
    a, b = (np.array([x[k] for x in rows], dtype=np.uint64) for k in (0, 1))
    first = np.bitwise_count(a[:, None] ^ a)
    u, v = np.nonzero(np.triu((first <= s.TAU) & (first + np.bitwise_count(b[:, None] ^ b) <= s.TAU_ALL), 1))
    low, node = s.forest(u, v)
    want = dict(zip(node.tolist(), low.tolist(), strict=True))
    n, both = s.bit_stats(df)
    for plan in (s.plan(df), s.plan(df, partitions=(3,)), list(zip(s.grouped(n, both, 4), (2, 2, 2, 1), strict=True))):
        found = np.array([tuple(p) for p in s.near_pairs(df, plan, every=False).collect()])
        assert len(u) > 1_000_000 > 100 * len(rows) > len(found)
        low, node = s.forest(found[:, 0], found[:, 1])
        assert dict(zip(node.tolist(), low.tolist(), strict=True)) == want


def test_buckets_of_every_size():
    """Of one bucket, and of many small ones, the pairs are those of brute force."""
    r = np.random.default_rng(2)
    for size, count in ((700, 2), (40, 30), (9, 100), (1, 50)):
        k = np.repeat(r.permutation(count).astype(np.uint32), size)
        base = r.integers(0, 1 << 63, (count * 3, 2), dtype=np.uint64)[r.integers(0, count * 3, len(k))]
        a, b = (base ^ (np.uint64(1) << r.integers(0, 64, base.shape).astype(np.uint64))).T
        inner = r.random(len(k)) < 0.5
        x = np.bitwise_count(a[:, None] ^ a)
        near = (k[:, None] == k) & (inner[:, None] | inner) & (x <= 10) & (x + np.bitwise_count(b[:, None] ^ b) <= 20)
        want = set(zip(*(c.tolist() for c in np.nonzero(np.triu(near, 1))), strict=True))
        i, j = s.bucket_links(k, inner, a, b, 10, 20, True)
        assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == want and len(i) == len(want)


def test_groups_against_union_find(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [tuple(r) for r in s.fingerprints(df).collect()]
    root = {i: i for i, _, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in brute(prints, s.TAU, s.TAU_ALL):
        a, b = sorted((find(u), find(v)))
        root[b] = a
    want = {i: find(i) for i in root}
    sizes = {r: [*want.values()].count(r) for r in set(want.values())}
    got = {r.doc_id: (r.group_id, r.group_size, r.keep) for r in s.groups(df).collect()}
    assert got == {i: (r, sizes[r], i == r) for i, r in want.items() if sizes[r] > 1}
    kept = {r.doc_id for r in s.keep_one(df).collect()}
    assert kept == {i for i, _ in rows} - {i for i, r in want.items() if i != r}
    assert len({r for i, r in want.items() if i < 60}) == 12  # the planted groups, whole
    assert all(sizes[r] == 1 for i, r in want.items() if i >= 1000)  # and nothing else


def test_long_chain(spark):
    """A chain in order of id, as versions of a page make it, takes few rounds."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(3000)] + [(10_000, 10_001)], "u long, v long").repartition(4)
    rounds = []
    got = {r.node: r.root for r in s.components(chain, rounds).collect()}
    assert got == {i: 0 for i in range(3001)} | {10_000: 10_000, 10_001: 10_000}
    assert len(rounds) <= 18 and rounds[0] < 0.75 * 3001


def test_scripts_without_spaces_signs_and_short_words(spark):
    r = random.Random(3)
    han = "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(400))
    kana = "".join(chr(r.randrange(0x3041, 0x3096)) for _ in range(400))
    short = " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("0123456789") for _ in range(300))
    rows = [("h1", han), ("h2", han[:200] + "一" + han[201:]), ("k1", kana), ("k2", kana + "。"), ("s1", "!!!"), ("s2", "!!!"), ("s3", "---"), ("w1", short), ("w2", short + " zz"), ("e1", " "), ("e2", " ")]
    got = {x.doc_id: x.group_id for x in s.groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"h1": "h1", "h2": "h1", "k1": "k1", "k2": "k1", "s1": "s1", "s2": "s1", "w1": "w1", "w2": "w1"}


def test_features_by_hand():
    column = pa.array(["abc d abc", "x" * 14, "", None, " \n", "?!", "é"])
    found = {}
    for a, _, row, code, size in Grams()(column):
        for i, c, n in zip(row.tolist(), code.tolist(), size.tolist(), strict=True):
            found.setdefault(i + a, []).append((c, n))
    assert {i: [n for _, n in v] for i, v in found.items()} == {0: [3, 1, 3], 1: [12, 12, 12], 5: [12], 6: [2]}
    assert found[0][0] == found[0][2] and len({*found[1]}) == 1


def test_odd_rows(odd, none):
    got = {r.doc_id: r.group_id for r in s.groups(odd).collect()}
    assert got == {1: 1, 2: 1}
    kept = s.keep_one(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns
    assert sorted(ids, key=str) == sorted([1, 3, 4, 5, None, None, 6, 7, 8, 9], key=str)
    assert s.groups(none).count() == 0 and s.keep_one(none).count() == 0


def test_repeated_rows_alone(spark):
    df = spark.createDataFrame([(1, prose(1, 50)), (1, prose(1, 50)), (2, prose(2, 50)), (2, prose(3, 50))], "doc_id long, text string")
    kept = s.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 2] and {r.text for r in kept} == {prose(i, 50) for i in (1, 2, 3)}
