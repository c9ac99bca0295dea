import corpus_pipeline
from pyspark.sql import functions as F

from tracewright.llm import bpe, decontam, quality, simhash, toxicity


def test_stages(spark, sf):
    """Each stage against its operator's decisions, taken one document at a time."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]

    def cached(df):
        return spark.createDataFrame(df.collect(), df.schema)

    a = cached(stages[0](spark, docs, sf))
    assert ids(a) == ids(quality.score(docs, labels).filter("keep")) and a.columns == docs.columns
    b = cached(stages[1](spark, a, sf))
    entries = toxicity.lexicon(stems=toxicity.learn_stems(a, labels))
    found, table = toxicity.automaton(entries), toxicity.fold_table()
    limit = toxicity.THRESHOLD
    slow = {r.doc_id for r in a.collect() if 100 * (h := toxicity.hits(r.text, found, table))[0] / max(h[2], toxicity.LEAST_WORDS) < limit}
    assert ids(b) == slow and b.columns == docs.columns
    c = cached(stages[2](spark, b, sf))
    assert ids(c) == ids(b) - ids(simhash.groups(b).filter("not keep")) and c.columns == docs.columns
    d = cached(stages[3](spark, c, sf))
    assert ids(d) == ids(c) - ids(decontam.find(c, benchmark)) and d.columns == docs.columns
    e = stages[4](spark, d, sf)
    enc = bpe.encoding(bpe.VOCABULARY)
    texts = {r.doc_id: r.text for r in d.collect()}
    rows = e.collect()
    assert len(rows) == len(texts)
    assert all(r.decoded == texts[r.doc_id] and list(r.token_ids) == enc.encode_ordinary(r.decoded) for r in rows)
    whole = corpus_pipeline.run(spark, sf)
    assert ids(whole) == ids(d) and whole.columns == e.columns


def test_toxic_and_leaking_documents_go(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = corpus_pipeline.run(spark, sf).select("doc_id")
    # So few labels teach few stems: only English is sure to be in the fixed lexicon.
    english = spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en'")
    toxic = labels.filter("toxic = 1").join(english, "doc_id", "left_semi")
    assert toxic.join(kept, "doc_id", "left_semi").count() <= 0.05 * toxic.count()
    assert labels.filter("quality = 0").join(kept, "doc_id", "left_semi").count() <= 0.05 * labels.count()


def test_odd_rows(spark, odd, none, sf):
    """What each stage leaves of the odd rows, by doc_id, from what the stage before left."""
    ids = lambda df: sorted((r[0] for r in df.collect()), key=str)
    every = ids(odd)
    left = {
        "quality classifier": None,  # its labels are of other documents: what it keeps is compared with its scores below
        "toxicity": every,
        "simhash near-dedup": sorted([1, 3, 4, 5, None, None, 6, 7, 8, 9], key=str),
        "benchmark decontamination": every,
        "byte-level bpe": every,
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        want = left[name]
        if want is None:
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            want = ids(quality.score(odd, labels).filter("keep").select("doc_id"))
            assert 0 < len(want) <= len(every)
        assert ids(out) == want, name
        assert stage(spark, none, sf).count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == odd.columns, name
    assert corpus_pipeline.STAGES[1][1](spark, odd, sf).filter(F.col("doc_id").isNull()).count() == 2


def test_near_copies_against_brute_force(spark, sf):
    """The third stage against all pairs of fingerprints and a union-find."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = [tuple(r) for r in simhash.fingerprints(docs).collect()]
    root = {i: i for i, _, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (u, a, b) in enumerate(prints):
        for v, c, d in prints[n + 1 :]:
            x = ((a ^ c) & (1 << 64) - 1).bit_count()
            if x <= simhash.TAU and x + ((b ^ d) & (1 << 64) - 1).bit_count() <= simhash.TAU_ALL:
                p, q = sorted((find(u), find(v)))
                root[q] = p
    kept = {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs, sf).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {i for i in root if find(i) != i}
