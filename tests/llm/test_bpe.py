import random

from tracewright.llm import bpe

TEXTS = ["", " ", "a  b", "x\n\n  y\t\tz ", "it's we'll 'twas don''t", "naïve — “quotes” 日本語 1234567 !!??", "a" * 5000, " " * 3000 + "end", "ab " * 4000, "…" * 900 + " 'll " * 500]


def chunked(text, chunk, overlap):
    parts = [(a, t, bpe.pre_token_ends(t, a)) for a, t in bpe.chunks_of(text, chunk, overlap)]
    return bpe.pieces_of(parts)


def test_stitched_pieces_encode_as_the_whole():
    enc = bpe.encoding(bpe.VOCABULARY)
    r = random.Random(1)
    mixed = ["".join(r.choice(" \n\tab'slré1!…  ") for _ in range(3000)) for _ in range(12)]
    for text in TEXTS + mixed:
        for chunk, overlap in ((64, 16), (200, 50), (1000, 10)):
            pieces = chunked(text, chunk, overlap)
            assert "".join(pieces) == text
            assert [t for p in pieces for t in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_very_long_runs():
    enc = bpe.encoding(bpe.VOCABULARY)
    encode = bpe.encoder_of(enc)
    for n in (bpe.LONG_RUN - 1, bpe.LONG_RUN, bpe.LONG_RUN + 1, 20_000):
        for text in ("a" + " " * n + "b", " " * n, "a\n" + " \t" * n + ".", " " * n + "\nx" + "\u3000" * n + "'ll", "x\x1c" + " " * n):
            assert encode(text) == enc.encode_ordinary(text), (n, text[:3])
    for text in (" " * 5_000_000 + "x", "ab " + "\n" * 3_000_000):
        assert enc.decode(encode(text)) == text


def test_white_space_is_that_of_the_pattern():
    enc = bpe.encoding(bpe.VOCABULARY)
    text = "!\x1c! a\x1d\x1eb  \x85c\xa0\xa0d\u180e e\u200b" * 40
    for chunk, overlap in ((16, 8), (50, 20)):
        assert [t for p in chunked(text, chunk, overlap) for t in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_long_texts_are_cut():
    assert len(chunked("word " * 5000, 1000, 100)) > 20


def test_round_trip_and_odd_rows(odd):
    out = bpe.encode(odd, chunk=5000, overlap=200).collect()
    given = sorted(((r.doc_id, r.text) for r in odd.collect()), key=str)
    assert sorted(((r.doc_id, r.decoded) for r in out), key=str) == given
    enc = bpe.encoding(bpe.VOCABULARY)
    for r in out:
        assert (r.token_ids is None) == (r.decoded is None) == (r.n_tokens is None)
        if r.token_ids is not None:
            assert r.n_tokens == len(r.token_ids)
            assert list(r.token_ids) == enc.encode_ordinary(r.decoded)


def test_decode_and_empty(spark, none, odd):
    assert bpe.encode(none).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None), (2, []), (3, [220, 50255 - 1])], "doc_id long, token_ids array<int>")).count() == 3
    kept = bpe.encode_rows(odd)
    assert {"lang", "score", "word"} <= set(kept.columns) and kept.columns.count("token_ids") == 1
