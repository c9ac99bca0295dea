import numpy as np
import pytest
from compare import difference, duck

from tracewright.llm import queries
from tracewright.llm import sharding as s


def slow_table(names, m):
    """By whole preference lists."""
    prefs = [[(s._number("offset " + n) % m + j * (s._number("skip " + n) % (m - 1) + 1)) % m for j in range(m)] for n in names]
    out, at = [-1] * m, 0
    while -1 in out:
        i = at % len(names)
        out[next(p for p in prefs[i] if out[p] < 0)] = i
        at += 1
    return out


def test_table():
    for n, m in ((1, 2), (3, 7), (5, 101), (7, 7)):
        assert s.lookup_table(s.shard_names(n), m).tolist() == slow_table(s.shard_names(n), m)
    t = s.lookup_table(s.shard_names(s.N_SHARDS))
    counts = np.bincount(t)
    assert counts.max() - counts.min() <= 1
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (list("abc"), 2)):
        with pytest.raises(ValueError):
            s.lookup_table(*bad)


def test_few_move_when_a_shard_goes():
    names = s.shard_names(20)
    a, b = s.lookup_table(names, 2003), s.lookup_table(names[:-1], 2003)
    assert ((a != b) & (a != 19)).mean() < 0.1


def test_placement(odd, none):
    import hashlib

    table = s.lookup_table(s.shard_names(s.N_SHARDS))
    out = s.shards(odd)
    assert out.columns == [c for c in odd.columns if c not in ("slot", "shard")] + ["slot", "shard"] and "a.b" in out.columns
    assert s.place(odd).columns == out.columns
    rows = out.collect()
    assert len(rows) == odd.count()
    for r in rows:
        key = str(r.doc_id) if r.doc_id is not None else r.text or ""
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % s.TABLE_SIZE
        assert r.slot == slot and r.shard == f"shard-{table[slot]:05d}"
    assert s.shards(none).count() == 0


def test_a_partition_is_a_shard(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "'t' as text")
    for n, m, parts in ((8, 101, 1), (8, 101, 3), (300, 7919, 2)):
        per = s.shards(df, s.shard_names(n), m, parts).selectExpr("shard", "spark_partition_id() as p").distinct().collect()
        assert len({r.p for r in per}) == len(per) and max(sum(r.shard == x.shard for x in per) for r in per[:8]) <= parts
        assert parts > 1 or len(per) == n


def test_sql(spark, sf):
    assert not difference(queries.op10_shards(spark, sf), duck(sf), queries.oracle_sql()["op10_shards"])
