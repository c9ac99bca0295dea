"""Byte-level BPE encoding and decoding (operator 9).

Method: overlapping chunks. A long text is cut into chunks that overlap; each
is pre-tokenised on its own, in parallel. A chunk may begin inside a
pre-token, but the pattern looks only forward, so as soon as a boundary of a
chunk is also one of the chunk before it, the two agree from there on. The
text is cut at such places, its pieces are encoded, and their ids follow one
another. Decoding joins the tokens' raw bytes.

A long run of white space is a pre-token by the pattern's own rule (all of it at
the end of a text; else all but its last character), and is cut off before the
pattern is run, whose look-ahead would go through it step by step.

Edge cases: a null text has null ids and decodes to null; an empty text has no
ids; a null doc_id and repeated rows pass through, each row by itself; doc_id
may be of any type; ties don't matter; an empty table gives no rows; other
columns, whatever their names, are ignored by encode(), and kept by
encode_rows(). A text without a place to cut is one piece, however long.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, renamed, without

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the tokenizer's pattern means it, which Python's differs from.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SAME = PATTERN.replace(r"[^\s\p", f"[^{SPACE}\\p").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
#: A run of white space from this length is taken out of the text.
LONG_RUN = 4_096
_RUN = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")
CHUNK, OVERLAP = 32_768, 1_024
#: A match that ends so close to the end of a cut chunk may not be the real one.
MARGIN = 8
IDS = T.ArrayType(T.IntegerType())


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def chunks_of(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(start, text) of the chunks: each begins `chunk` after the last and runs
    on for `overlap` more."""
    return [(a, text[a : a + chunk + overlap]) for a in range(0, max(len(text) - overlap, 1), chunk)]


def pre_token_ends(text: str, start: int = 0) -> list[int]:
    import regex

    return [start + m.end() for m in regex.finditer(_SAME, text)]


def encoder_of(enc):
    """text to ids, as enc.encode_ordinary, whatever the length of its runs of white space."""

    def encode(text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return enc.encode_ordinary(text)
        ids, at = [], 0
        for run in _RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += enc.encode_ordinary(text[at : run.start()]) + enc._encode_single_piece(text[run.start() : end])
            at = end
        return ids + enc.encode_ordinary(text[at:])

    return encode


def cuts_of(chunks: list[tuple[int, str, list[int]]]) -> list[int]:
    """Where the text may be cut, from the chunks' (start, text, ends), in order.
    A cut ends a pre-token of both chunks and follows a character that isn't
    white space (only then the piece alone is pre-tokenised as in the text).
    A pre-token that outruns the overlap leaves no cut: the pieces on its
    sides stay one."""
    cuts = []
    for (a, left, ends), (b, _, right) in zip(chunks, chunks[1:], strict=False):
        right_ends, last = set(right), a + len(left) - MARGIN
        for p in ends:
            if b < p <= last and p in right_ends and left[p - a - 1] not in SPACE:
                cuts.append(p)
                break
    return cuts


def pieces_of(chunks: list[tuple[int, str, list[int]]]) -> list[str]:
    """The text between the cuts, put together from the chunks."""
    text, end = [], 0
    for a, part, _ in chunks:
        text.append(part[end - a :])
        end = a + len(part)
    whole, cuts = "".join(text), cuts_of(chunks)
    return [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True)]


def shipped(spark: SparkSession, path: str) -> str:
    """Sends the vocabulary to every executor; gives the name that it has there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _encoder(name: str, decoded: bool):
    """Arrow in, Arrow out: `text` becomes token_ids (and decoded, if asked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(SparkFiles.get(name))
        encode, decode = encoder_of(enc), enc.decode_bytes
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                i = batch.schema.get_field_index("text")
                ids = [None if t is None else encode(t) for t in batch.column(i).to_pylist()]
                columns = [c for j, c in enumerate(batch.columns) if j != i]
                names = [n for j, n in enumerate(batch.schema.names) if j != i]
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("token_ids")
                if decoded:
                    columns.append(pa.array([None if x is None else decode(x).decode("utf-8", "replace") for x in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _chunker(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for start, part in chunks_of(text, chunk, overlap):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([start], pa.int64()), pa.array([part])], names=["key", "start", "part"])

    return run


def _pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, parts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        ends = pa.array([pre_token_ends(t, s) for s, t in zip(starts, parts, strict=True)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, ends], names=["key", "start", "part", "ends"])


def _stitch(t: pa.Table) -> pa.Table:
    t = t.sort_by("start")
    chunks = list(zip(t["start"].to_pylist(), t["part"].to_pylist(), t["ends"].to_pylist(), strict=True))
    parts = pieces_of(chunks)
    return pa.table({"key": pa.array([t["key"][0].as_py()] * len(parts)), "piece": pa.array(range(len(parts)), pa.int64()), "text": pa.array(parts)})


def encode_long(texts: DataFrame, name: str, chunk: int, overlap: int) -> DataFrame:
    """(key, text) of distinct keys to (key, token_ids), chunk by chunk; name: of the vocabulary shipped."""
    spark = texts.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    chunks = texts.select("key", "text").mapInArrow(_chunker(chunk, overlap), "key string, start long, part string")
    ends = chunks.repartition(n, "key", "start").mapInArrow(_pre_tokenise, "key string, start long, part string, ends array<long>")
    pieces = ends.groupBy("key").applyInArrow(_stitch, "key string, piece long, text string")
    ids = pieces.repartition(n, "key", "piece").mapInArrow(_encoder(name, False), "key string, piece long, token_ids array<int>")
    ordered = F.sort_array(F.collect_list(F.struct("piece", "token_ids")))
    return ids.groupBy("key").agg(F.flatten(F.transform(ordered, lambda x: x["token_ids"])).alias("token_ids"))


def _decoder(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoding(SparkFiles.get(name)).decode_bytes
        for batch in batches:
            i = batch.schema.get_field_index("token_ids")
            column = [None if x is None else decode(x).decode("utf-8", "replace") for x in batch.column(i).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(column, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def decode(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, token_ids) to (doc_id, token_ids, decoded): the joined raw bytes
    as UTF-8 (a bad byte becomes U+FFFD); null ids decode to null."""
    df = need(df, "doc_id", "token_ids")
    return df.mapInArrow(_decoder(shipped(df.sparkSession, vocabulary)), T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))


def encode_rows(df: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """All columns of df but text, then token_ids, n_tokens and decoded (the
    text again, from the ids). Columns of df with one of these three names are
    replaced."""
    df = without(df, "token_ids", "n_tokens", "decoded")
    names = [c for i, c in enumerate(df.columns) if i != df.columns.index("text")]
    df, vocabulary = renamed(df, "text"), shipped(df.sparkSession, vocabulary)
    rest = [c for c in df.columns if c != "text"]
    fields = [df.schema[c] for c in rest]
    out = T.StructType([*fields, T.StructField("token_ids", IDS), T.StructField("decoded", T.StringType())])
    is_long = F.coalesce(F.length(df["text"]) > chunk, F.lit(False))
    short = df.filter(~is_long).select(*rest, "text").mapInArrow(_encoder(vocabulary, True), out)
    long_rows = df.filter(is_long)
    key = F.sha2(df["text"], 256)
    distinct = long_rows.select(key.alias("key"), "text").dropDuplicates(["key"])
    ids = encode_long(distinct, vocabulary, chunk, overlap)
    both = long_rows.select(F.struct(*rest).alias("row"), key.alias("key")).join(ids, "key").select("row.*", "token_ids")
    long_out = both.mapInArrow(_decoder(vocabulary), out)
    found = short.unionByName(long_out).select(*rest, "token_ids", F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).alias("n_tokens"), "decoded")
    return found.toDF(*names, "token_ids", "n_tokens", "decoded")


def encode(df: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, token_ids, n_tokens, decoded) of every row."""
    return encode_rows(need(df, "doc_id", "text"), vocabulary, chunk, overlap)
