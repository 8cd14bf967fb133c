"""Byte-level BPE over a whole corpus: every distinct pre-token is encoded once, whoever has it.

Texts are cut into pre-tokens with their positions. So that a frequent word costs one entry a block and not one
row an occurrence, a block of documents lists its distinct pre-tokens, most frequent first, and keeps its
positions as indexes into that list. A list is dealt out by the hash of its words: one packed row for each block
and bucket. A bucket meets all blocks' words of its hashes, encodes each distinct one once and answers each row
with ids; the blocks put these together by position. Decoding looks each id up in the table of token bytes,
which has a row for each id of the vocabulary.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm.common import mapped, materialize_by, read, rows_of, whole_text

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of text in a block; a longer document has a block of its own.
BLOCK_BYTES = 12 << 20
#: Pre-tokens whose positions are packed together; a longer document is packed alone.
CHUNK_WORDS = 1 << 17
#: Buckets of word hashes for each shuffle partition.
BUCKETS = 2
#: Decoded pieces that are put together at a time.
GATHER_IDS = 1 << 18


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def _table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and the start and length of each id's."""
    ranks = _ranks(path)
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    words = [b""] * len(length)
    for word, i in ranks.items():
        words[i], length[i] = word, len(word)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(length) - length, length


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(public_tokenizers.PATTERN)


# --- packed lists ----------------------------------------------------------------------------------------------
def _pack(parts: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, parts), "<u4", len(parts))
    return zstandard.compress(np.uint32(len(parts)).tobytes() + lengths.tobytes() + b"".join(parts), 3)


def _unpack(packed: bytes) -> list[bytes]:
    body = zstandard.decompress(packed)
    n = int(np.frombuffer(body, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(body, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    starts = [4 + 4 * n, *ends[:-1].tolist()]
    return [body[a:b] for a, b in zip(starts, ends.tolist(), strict=True)] if n else []


def _pack_numbers(values: np.ndarray) -> bytes:
    """Unsigned numbers, their four bytes apart: the high ones are mostly zero."""
    return zstandard.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpack_numbers(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


# --- cutting ---------------------------------------------------------------------------------------------------
def _cut(buckets: int):
    """For each block its documents (doc_id, places) and, by bucket, its words (packed, with their places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _pattern().findall
        for docs, texts in _blocks(batches):
            block = uuid.uuid4().int >> 65
            code: dict[str, int] = {}
            places = []
            for text in texts:
                words = find(text)
                for w in words:
                    if w not in code:
                        code[w] = len(code)
                places.append(np.fromiter(map(code.__getitem__, words), "<u4", len(words)))
            used = sum((np.bincount(np.concatenate(places[i : i + 512]), minlength=len(code)) for i in range(0, len(places), 512)), np.zeros(len(code), np.int64))
            order = np.argsort(-used, kind="stable")
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order), dtype="<u4")
            lengths = [len(p) for p in places]
            for a, b in _chunks(lengths):
                yield _batch(block, docs[a:b], lengths[a:b], _pack_numbers(place[np.concatenate(places[a:b])]), None, None)
            words = [w.encode() for w in code]
            del code, places
            bucket = np.fromiter(((zlib.crc32(w) % buckets) for w in words), np.int64, len(words))[order]
            by_bucket = np.argsort(bucket, kind="stable")  # ascending places in each bucket
            cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
            for b in range(buckets):
                at = by_bucket[cuts[b] : cuts[b + 1]]
                if len(at):
                    steps = np.diff(at, prepend=0)
                    yield _batch(block, None, None, _pack_numbers(steps), b, _pack([words[i] for i in order[at].tolist()]))

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts of BLOCK_BYTES at a time."""
    docs, texts, size = [], [], 0
    for batch in rows_of(batches, 1 << 20):
        docs += batch.column("doc_id").to_pylist()
        texts += batch.column("_text").to_pylist()
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            yield docs, texts
            docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def _chunks(lengths: list[int]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > CHUNK_WORDS:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


CUT = "block long, doc_ids array<long>, lengths array<long>, places binary, bucket long, words binary"


def _batch(block: int, docs: list | None, lengths: list | None, places: bytes, bucket: int | None, words: bytes | None) -> pa.RecordBatch:
    listed = pa.list_(pa.int64())
    columns = [pa.array([block], pa.int64()), pa.array([docs], listed), pa.array([lengths], listed), pa.array([places], pa.binary()), pa.array([bucket], pa.int64()), pa.array([words], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "lengths", "places", "bucket", "words"])


# --- encoding --------------------------------------------------------------------------------------------------
def _encode_words(path: str):
    """Answers each row's words with their ids; rows come sorted by bucket, whose words are remembered till its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, one = _ranks(path), _encoding(path)._encode_single_piece
        known: dict[bytes, bytes] = {}
        current = None
        for batch in rows_of(batches):
            out = []
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if bucket != current:
                    known, current = {}, bucket
                words = _unpack(packed)
                for w in words:
                    if w not in known:
                        rank = ranks.get(w)
                        known[w] = np.array([rank] if rank is not None else one(w), "<u4").tobytes()
                out.append(_pack([known[w] for w in words]))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("places"), pa.array(out, pa.binary())], ["list_block", "at", "ids"])

    return run


def _assemble(documents: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of a block's documents, by position."""
    at, ids = [], []
    for steps, packed in zip(words.column("at").to_pylist(), words.column("ids").to_pylist(), strict=True):
        at.append(np.cumsum(_unpack_numbers(steps), dtype=np.int64))
        ids += _unpack(packed)
    order = np.argsort(np.concatenate(at)) if at else np.zeros(0, np.int64)
    ids = [ids[i] for i in order.tolist()]
    docs, out = [], []
    for some, lengths, packed in zip(*(documents.column(c).to_pylist() for c in ("doc_ids", "lengths", "places")), strict=True):
        flat, start = _unpack_numbers(packed).tolist(), 0
        for n in lengths:
            out.append(b"".join(map(ids.__getitem__, flat[start : start + n])))
            start += n
        docs += some
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "ids": pa.array(out, pa.binary())})


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every row of docs.

    Null and empty texts have no ids. Repeated rows stay repeated rows. Ids are those that the byte-pair merges
    give for each match of the pattern; special tokens are ordinary text.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("_text"))
    cut = materialize_by(source.transform(mapped, _cut(BUCKETS * parts), CUT), "cut", "block", parts)  # positions stay where they are
    listed = cut.where("words IS NOT NULL").select("block", "places", "bucket", "words")
    listed = listed.repartition("bucket").sortWithinPartitions("bucket")
    words = listed.transform(mapped, _encode_words(vocabulary), "list_block long, at binary, ids binary")
    documents = cut.where("words IS NULL").select("block", "doc_ids", "lengths", "places")
    return documents.groupBy("block").cogroup(words.groupBy("list_block")).applyInArrow(_assemble, "doc_id long, ids binary")


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """The bytes of ids, by the token-byte table."""
    flat, start, length = _table(path)
    out = []
    for a in range(0, len(ids), GATHER_IDS):
        part = ids[a : a + GATHER_IDS]
        size = length[part]
        end = np.cumsum(size)
        at = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start[part] - (end - size), size)
        out.append(flat[at].tobytes())
    return b"".join(out)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            ids = batch.column("ids").to_pylist()
            texts = [decode_ids(np.frombuffer(x, "<u4"), path) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return run


def decode(coded: DataFrame, vocabulary: str) -> DataFrame:
    """coded (doc_id, ids) with decoded: the bytes that the ids stand for."""
    return coded.select("doc_id", "ids").transform(mapped, _decode(vocabulary), "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    both = decode(encode(docs, vocabulary, text), vocabulary)
    return both.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
