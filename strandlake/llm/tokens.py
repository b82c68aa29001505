"""Encode a corpus with a public byte-level BPE vocabulary.

A text longer than a chunk is cut into overlapping chunks that are pre-tokenised in
parallel. Two neighbouring chunks are stitched at the first boundary that both find in
their overlap between a word and white space: the pattern looks ahead but
never back, so from a shared boundary on both agree. The pieces between stitches are
encoded in parallel and their ids put together. A text whose chunks don't resynchronise
within the overlap is encoded as one piece. Shorter texts are a single piece.

The vocabulary file (base64 token and rank in each line) is a parameter; its bytes, of
fixed size, are broadcast.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the published pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CHUNK, OVERLAP = 16_384, 512  #: characters
_SPACES = (" ", "\n", "\r", "\t")
SURE = 2  #: characters after a boundary that the pattern must see to be certain of it


@lru_cache(4)
def _encoding(vocabulary: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def _splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def boundaries(text: str, pattern: str, whole_to: int) -> list[int]:
    """Ends of pre-tokens that can't change with what follows ``text``, between a word and white space.

    whole_to: ends beyond this are left out, as the pattern can't see far enough. Only ends
    before white space count, so that nothing hangs on which characters the two regular
    expression libraries take for letters; and only after other than white space, as a
    run of white space ends differently at the end of a piece.
    """
    ends = (m.end() for m in _splitter(pattern).finditer(text))
    return [e for e in ends if e <= whole_to and text[e : e + 1] in _SPACES and not text[e - 1].isspace()]


def _values(texts: list[str | None], vocabulary, pattern: str, counts: bool) -> pa.Array:
    encode = _encoding(vocabulary.value, pattern).encode_ordinary
    if counts:
        return pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())
    return pa.array([encode(t) if t else [] for t in texts], pa.list_(pa.int32()))


def _encode(batches: Iterator[pa.RecordBatch], keys: list[str], vocabulary, pattern: str, counts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            out = _values(part.column("text").to_pylist(), vocabulary, pattern, counts)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), out], [*keys, "ids"])


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            digest = hashlib.blake2b(text.encode(), digest_size=16).hexdigest()
            starts = range(0, len(text), chunk)
            for a in range(0, len(starts), 64):
                at = starts[a : a + 64]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * len(at), batch.schema.field("id").type), pa.array([digest] * len(at)), pa.array([k // chunk for k in at], pa.int64()),
                        pa.array([k + chunk >= len(text) for k in at]), pa.array([text[k : k + chunk + overlap] for k in at]),
                    ],
                    ["id", "digest", "k", "final", "text"],
                )


def _overlaps(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int, pattern: str) -> Iterator[pa.RecordBatch]:
    """Boundaries of each chunk in the overlaps with its neighbours, as places in the document."""
    for batch in batches:
        heads, tails = [], []
        for k, final, text in zip(*(batch.column(c).to_pylist() for c in ("k", "final", "text"))):
            ends = boundaries(text, pattern, len(text) if final else len(text) - SURE)
            heads.append([k * chunk + e for e in ends if e <= overlap] if k else [])
            tails.append([k * chunk + e for e in ends if e > chunk])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("id", "digest", "k", "copies")), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
            ["id", "digest", "k", "copies", "head", "tail"],
        )


def _pieces(batches: Iterator[pa.RecordBatch], chunk: int, vocabulary, pattern: str, counts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("k", "start", "stop", "text"))
        texts = [t[a - k * chunk : None if b is None else b - k * chunk] for k, a, b, t in zip(*columns)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "digest", "k", "copies")), _values(texts, vocabulary, pattern, counts)], ["id", "digest", "k", "copies", "ids"])


def encode_corpus(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    counts: bool = False,
) -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of each row, or with ``counts`` their number (long).

    Special tokens are never made; their strings are ordinary text. Empty and null texts
    have no ids (an empty list, or 0). One row comes out for each row that goes in,
    repeated ids and rows too; a null id is kept. Other columns are ignored. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        words = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = rows.schema["id"].dataType.simpleString()
    kind = "long" if counts else "array<int>"
    size = F.length("text")

    short = rows.filter(size.isNull() | (size <= chunk)).mapInArrow(partial(_encode, keys=["id"], vocabulary=words, pattern=pattern, counts=counts), f"id {key}, ids {kind}")

    chunks = (
        rows.filter(size > chunk)
        .mapInArrow(partial(_chunks, chunk=chunk, overlap=overlap), f"id {key}, digest string, k long, final boolean, text string")
        .groupBy("id", "digest", "k")
        .agg(F.first("final").alias("final"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    )
    found = chunks.mapInArrow(partial(_overlaps, chunk=chunk, overlap=overlap, pattern=pattern), f"id {key}, digest string, k long, copies long, head array<long>, tail array<long>")
    doc = Window.partitionBy("id", "digest")
    shared = F.array_min(F.array_intersect(F.lag("tail").over(doc.orderBy("k")), F.col("head")))
    cuts = found.withColumn("start", F.when(F.col("k") == 0, F.lit(0)).otherwise(shared))
    cuts = cuts.withColumn("stop", F.lead("start").over(doc.orderBy("k"))).withColumn("apart", F.max(F.col("start").isNull()).over(doc)).drop("head", "tail", "copies")
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"x.{c}")) for c in ("id", "digest", "k")]
    cut = chunks.alias("c").join(cuts.alias("x"), same[0] & same[1] & same[2]).select("c.id", "c.digest", "c.k", "c.copies", "c.text", "x.start", "x.stop", "x.apart")
    pieces = cut.filter(~F.col("apart")).mapInArrow(partial(_pieces, chunk=chunk, vocabulary=words, pattern=pattern, counts=counts), f"id {key}, digest string, k long, copies long, ids {kind}")
    put = F.sum("ids") if counts else F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda p: p["ids"]))
    stitched = pieces.groupBy("id", "digest", "copies").agg(put.alias("ids"))
    core = F.substring("text", 1, chunk)
    unstitched = (
        cut.filter("apart")
        .groupBy("id", "digest", "copies")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", core.alias("core")))), lambda p: p["core"]), "").alias("text"))
        .mapInArrow(partial(_encode, keys=["id", "digest", "copies"], vocabulary=words, pattern=pattern, counts=counts), f"id {key}, digest string, copies long, ids {kind}")
    )
    long = stitched.unionByName(unstitched).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("id", "ids")
    return short.union(long).select(F.col("id").alias(id_col), F.col("ids").alias("n_tokens" if counts else "ids"))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col`` and ``n_tokens`` of each row; see :func:`encode_corpus`."""
    return encode_corpus(docs, id_col, text_col, counts=True, **options)


def _decode(batches: Iterator[pa.RecordBatch], vocabulary, pattern: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        decode = _encoding(vocabulary.value, pattern).decode_bytes
        texts = [None if ids is None else decode(ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``id_col`` and ``text``: the tokens' raw bytes put together and read as UTF-8.

    Bytes that aren't UTF-8, which encoding never makes, come out as U+FFFD; null ids
    as null; an unknown id fails.
    """
    with open(vocabulary, "rb") as f:
        words = encoded.sparkSession.sparkContext.broadcast(f.read())
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    key = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(partial(_decode, vocabulary=words, pattern=pattern), f"id {key}, text string")
    return out.withColumnRenamed("id", id_col)
