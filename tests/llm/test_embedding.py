import numpy as np

from tracewright.llm import embedding as e


def brute(rows, cosine=e.COSINE):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(x @ x.T >= cosine, 1))
    return {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in zip(i, j, strict=True) if ids[a] != ids[b]}


def brute_classes(rows, cosine=e.COSINE):
    """{id: (class, its size, links)} of vectors that have a direction."""
    links = brute(rows, cosine)
    near = {i: set() for i, _ in rows}
    for a, b in links:
        near[a].add(b), near[b].add(a)
    out = {}
    for i in sorted(near):
        if i not in out:
            group, front = {i}, [i]
            while front:
                new = near[front.pop()] - group
                group |= new
                front += new
            out |= {k: (i, len(group), len(near[k])) for k in group}
    return out


def classes(df, **how):
    found = e.classes(df, **how).collect()
    assert len(found) == len({r.vec_id for r in found})
    return {r.vec_id: (r.class_id, r.class_size, r.links) for r in found}


def test_a_row_for_each_id(spark):
    """A crowd of different near vectors, copies, chains and single vectors, at dimensions 3 and 40: all links, by their number."""
    r = np.random.default_rng(9)
    rows, want = [], {}
    for dim, crowd in ((40, 500), (3, 30)):
        base = r.standard_normal((6, dim))
        own = [base[0] + r.standard_normal(dim) * 0.15 for _ in range(crowd)] + [base[1]] * 7 + [base[1] + r.standard_normal(dim) * 0.01] * 3
        own += [base[2] + (base[3] - base[2]) * k / 12 for k in range(13)] + list(r.standard_normal((200 if dim > 3 else 0, dim)))
        own = [(1_000 * dim + int(i), v.astype(np.float32)) for i, v in zip(r.permutation(len(own)), own, strict=True)]
        rows += own
        want |= brute_classes(own)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<float>").repartition(4)
    assert max(n for _, _, n in want.values()) > 200
    assert classes(df) == classes(df, block_rows=90) == want


def test_limit_is_exact(spark):
    """Pairs so near the limit that single precision can't tell."""
    rows = []
    for k in range(200):
        t = np.arccos(e.COSINE) + (k - 100) * 1e-9
        at = np.zeros((2, 8))
        at[0, :2], at[1, :2] = (1, 0), (np.cos(t), np.sin(t))
        turn = np.linalg.qr(np.random.default_rng(k).standard_normal((8, 8)))[0]
        rows += [(2 * k, (at[0] @ turn).tolist()), (2 * k + 1, (at[1] @ turn).tolist())]
    found = {(p.vec_a, p.vec_b) for p in e.pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for k in range(200):
        if k != 100:
            assert ((2 * k, 2 * k + 1) in found) == (k < 100), k


def test_classes_of_odd_vectors(spark):
    v, x = [1.0, 2.0, 3.0], [9.0, 0.0, 0.0]
    rows = [("b", v), ("c", v), ("c", v), ("d", [2.0, 4.0, 6.0]), ("d", x), ("d", [9.0, 0.01, 0.0]), ("a", x), ("e", None), ("f", []), ("g", [0.0, 0.0, 0.0]), ("g2", [0.0, 0.0, 0.0]), ("h", [float("nan"), 1.0, 1.0]), ("i", [None, 1.0, 1.0]), (None, v), ("j", [1.0, 2.0]), ("k", [1.0, 2.001]), ("l", [float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>").selectExpr("*", "'x' as key", "1 as e", "2 as block", "3 as `a.b`")
    want = {"a": ("a", 4, 1), "b": ("a", 4, 2), "c": ("a", 4, 2), "d": ("a", 4, 3), "j": ("j", 2, 1), "k": ("j", 2, 1)} | {i: (i, 1, 0) for i in ("e", "f", "g", "g2", "h", "i", "l")}
    assert classes(df) == want
    assert classes(df.limit(0)) == {}


def test_recall_and_precision(spark):
    r = np.random.default_rng(1)
    rows = []
    for g in range(60):
        base = r.standard_normal(32)
        for k in range(1 + g % 6):
            rows.append((len(rows), (base + r.standard_normal(32) * 0.05 * (1 + k)).astype(np.float32)))
    rows += [(10_000 + i, r.standard_normal(32).astype(np.float32)) for i in range(300)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>").repartition(5)
    want = brute(rows)
    for size in (e.BLOCK_ROWS, 40):
        got = {(p.vec_a, p.vec_b): p.cosine for p in e.pairs(df, block_rows=size).collect()}
        assert got.keys() <= want and len(got) >= 0.95 * len(want) and len(want) > 50
        assert all(c >= e.COSINE - 1e-6 for c in got.values())


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (3, v), (3, v), (4, [2.0, 4.0, 6.0]), (5, None), (6, []), (7, [0.0, 0.0, 0.0]), (8, [float("nan"), 1.0, 1.0]), (9, [None, 1.0, 1.0]), (None, v), (10, [1.0, 2.0]), (11, [1.0, 2.001]), (12, [float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as vec_a", "1 as p", "2 as block", "3 as `a.b`", "4 as EMBEDDING")
    got = {(p.vec_a, p.vec_b) for p in e.pairs(df).collect()}
    sound = [(i, x) for i, x in rows if i in (1, 2, 3, 4, 10, 11)]
    assert got == brute([r for r in sound if len(r[1]) == 3]) | brute([r for r in sound if len(r[1]) == 2]) and len(got) == 7
    assert e.pairs(df.limit(0)).count() == 0


def test_copies_against_brute_force(spark):
    """Every copy is a query: groups of equal vectors, in several slices too, with near vectors on either side."""
    r = np.random.default_rng(5)
    base = [r.standard_normal(16) for _ in range(4)]
    vectors = [base[0]] * 600 + [base[0] + r.standard_normal(16) * 0.01] * 3 + [base[0] + r.standard_normal(16) * 0.01, *[base[1]] * 4, 2 * base[1], base[2], base[3]]
    ids = [int(i) for i in r.permutation(len(vectors))]
    rows = [(i, [float(e) for e in v]) for i, v in zip(ids, vectors, strict=True)]
    # One id with two vectors of different groups, and a repeated row: neither is paired with itself.
    rows += [(ids[0], rows[605][1]), (ids[0], rows[602][1]), rows[1]]
    found = e.pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
    assert len(found) == len({(p.vec_a, p.vec_b) for p in found})
    assert {(p.vec_a, p.vec_b) for p in found} == brute(rows)
    assert all(p.cosine >= e.COSINE for p in found)


def test_recall_at_the_limit_of_few_or_unequal_dimensions(spark):
    r = np.random.default_rng(7)
    rows, planted = [], {}
    for name, scale in {"2": np.ones(2), "8": np.ones(8), "64, i^-1.5": np.arange(1, 65) ** -0.75, "63, i^-2": 1.0 / np.arange(1, 64)}.items():
        for _ in range(300):
            u, g = r.standard_normal(len(scale)) * scale, r.standard_normal(len(scale)) * scale
            u /= np.linalg.norm(u)
            g -= (g @ u) * u
            c = r.uniform(0.9505, 0.955)
            planted.setdefault(name, set()).add((len(rows), len(rows) + 1))
            rows += [(len(rows), u.tolist()), (len(rows) + 1, (c * u + np.sqrt(1 - c * c) * g / np.linalg.norm(g)).tolist())]
    found = {(p.vec_a, p.vec_b) for p in e.pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    recall = {name: len(own & found) / len(own) for name, own in planted.items()}
    assert min(recall.values()) >= 0.93, recall


def test_ids_of_text(spark):
    rows = [("b", [1.0, 2.0, 0.0]), ("a", [1.0, 2.0, 0.01]), ("c", [1.0, 2.0, 0.0]), ("d", [-1.0, 0.0, 5.0])]
    got = {(p.vec_a, p.vec_b) for p in e.pairs(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
