import random

from llm_helpers import prose

from tracewright.llm import decontam as d


def distance(item, text):
    """Least edits of item to any part of text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_against_the_full_table():
    r = random.Random(2)
    for _ in range(300):
        item = "".join(r.choice("abc ") for _ in range(r.randint(1, 90)))
        text = "".join(r.choice("abc ") for _ in range(r.randint(0, 120)))
        want = distance(item, text)
        got = d.myers(d.peq_of(item), len(item), text, len(item))
        assert (got[0] if got else len(item)) == min(want, len(item))


def test_pieces_cover_the_item():
    for m in (1, 11, 13, 40, 333):
        item = "x" * m
        k = d.budget_of(m)
        parts = d.pieces_of(item, k)
        assert len(parts) == k + 1 and "".join(p for _, p in parts) == item and all(p for _, p in parts)


def edited(text, n, seed):
    r = random.Random(seed)
    chars = list(text)
    for _ in range(n):
        i = r.randrange(len(chars))
        chars[i] = r.choice(["", "q", chars[i] + "z"])
    return "".join(chars)


def test_against_brute_force(spark):
    items = [(i, prose(100 + i, 25)) for i in range(6)] + [(50, None), (51, ""), (52, "!!"), (7, prose(103, 25)), (60, "bo"), (61, "lone item")]
    docs = []
    for i in range(40):
        body = prose(i, 40)
        if i % 2:
            body += ". " + edited(items[i % 6][1], i % 11 * 2, i).upper() + "; " + prose(900 + i, 20)
        docs.append((i, body))
    docs += [(None, items[0][1]), (77, None), (78, ""), (79, items[1][1]), (79, items[1][1]), (80, "Bo"), (81, "bo hello"), (82, "a lone item here"), (83, "lone item!")]
    dd, bb = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    import re

    norm = lambda t: re.sub(r"[^\w]+", " ", t.lower()).strip()
    want = set()
    for i, t in docs:
        for n, item in items:
            if t and item and norm(item):
                k, e = d.budget_of(len(norm(item))), distance(f" {norm(item)} ", f" {norm(t)} ")
                if len(norm(item)) < d.WHOLE_CHARS:
                    e = max(e, distance(f" {norm(t)} ", f" {norm(item)} "))
                if e <= k:
                    want.add((i, n, e))
    assert {(80, 60), (83, 61)} <= {(i, n) for i, n, _ in want} and not {81, 82} & {i for i, *_ in want}
    for sizes in ({}, {"slice_chars": 400, "group_chars": 900}, {"slice_chars": 300, "pass_chars": 600}):
        got = [tuple(r)[:3] for r in d.find(dd, bb, **sizes).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    named = bb.selectExpr("concat('Set/', item_id) as item_id", "text", "1 as `x.y`")
    assert {(r.doc_id, int(r.item_id[4:]), r.distance) for r in d.find(dd, named).collect() if r.item_id} == want
    kept = d.keep_clean(dd, bb, slice_chars=400, pass_chars=800)
    leaking = {i for i, _, _ in want}
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - leaking


def test_one_scan_for_many_slices(spark):
    dd = spark.createDataFrame([(i, prose(i, 40)) for i in range(10)], "doc_id long, text string")
    bb = spark.createDataFrame([(i, prose(500 + i, 30)) for i in range(50)], "item_id long, text string")
    plan = d.find(dd, bb, slice_chars=300)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    passes = list(d._passes(bb, 300, 20_000_000))
    assert len(passes) == 1 and len(passes[0]) > 20 and sum(map(len, passes[0])) == 50


def test_odd_rows(spark, odd, none):
    b = spark.createDataFrame([(1, "zzzz zzzz zzzz zzzz zzzz")], "item_id long, text string")
    assert d.find(odd, b).count() == 0 and d.find(none, b).count() == 0
    assert d.keep_clean(odd, b).count() == odd.count() and d.keep_clean(odd, b.limit(0)).columns == odd.columns
