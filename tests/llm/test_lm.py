import math
import re
from collections import Counter, defaultdict

from compare import difference, duck
from llm_helpers import prose

from tracewright.llm import lm, queries


def brute(rows, order=lm.ORDER, backoff=lm.BACKOFF):
    words = [re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower()) for _, t in rows]
    count = Counter(tuple(ws[i : i + k]) for ws in words for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    total = sum(map(len, words))
    n, s = Counter(), defaultdict(float)
    for (doc, _), ws in zip(rows, words, strict=True):
        if doc is None:
            continue
        n[doc] += len(ws)
        for i in range(len(ws)):
            factor = 1.0
            for k in range(min(order, i + 1), 0, -1):
                gram = tuple(ws[i - k + 1 : i + 1])
                if count[gram] > 1:
                    s[doc] += math.log(factor * (count[gram] - 1) / (count[gram[:-1]] - 1 if k > 1 else total - 1))
                    break
                factor *= backoff
            else:
                s[doc] += math.log(factor / total)
    return {d: (n[d], round(s[d], 3) if n[d] else None) for d in n}


def check(df, order=lm.ORDER, **parameters):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", df["`text`"]).collect()] if "TEXT" not in df.columns else [(r[0], r[1]) for r in df.collect()]
    got = {r.doc_id: (r.n_words, r.log_score) for r in lm.score(df, order, **parameters).collect()}
    want = brute(rows, order)
    assert got.keys() == want.keys()
    for d, (n, s) in want.items():
        assert got[d][0] == n and (got[d][1] is None) == (s is None) and (s is None or abs(got[d][1] - s) < 0.0021), (d, got[d], n, s)


def test_against_brute_force(spark):
    rows = [(i, prose(i % 7, 40) + " " + prose(i, 30) + " the the of the") for i in range(60)] + [(3, "the of"), (None, "the of the"), (500, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df)
    check(df, order=2)
    check(df, rows=500)  # several partitions, with hot words
    check(df, rows=500, frequent=5, passes=3)  # most counts by a join
    check(df, rows=100, frequent=0)
    check(df.selectExpr("concat('d', doc_id) as doc_id", "text"), rows=1000)


def test_copies_score_apart(spark):
    """A document that occurs twice is likely by the model of the whole corpus."""
    rows = [(i, prose(i, 60)) for i in range(40)] + [(100, prose(3, 60))]
    got = {r.doc_id: r.mean_log_score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[3], got[100]) > max(v for d, v in got.items() if d not in (3, 100)) + 1


def test_odd_rows(odd, none):
    check(odd)
    check(odd, rows=5000, frequent=3)
    assert lm.score(none).count() == 0


def test_sql(spark, sf):
    assert not difference(queries.op6_lm_scores(spark, sf), duck(sf), queries.oracle_sql()["op6_lm_scores"])
