"""Token-id output: documents as ids in a byte-aligned variable-length code, written in document order.

Ids are replaced by their rank by frequency, so the common ones take one byte. A block keeps its control bytes
(two bits for each value: its length in bytes less one) apart from its data bytes, so a reader finds every
value's place with a 256-row table and a prefix sum, in numpy. A block is one self-describing byte string and a
row of a Parquet table, so that any store that Spark reaches can hold it; `unpack` reads a block alone.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acervo.llm.common import mapped, materialize, new_path, read, rows_of, whole_text

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Ids that a block gathers before it is closed; a single document may make it longer.
BLOCK_IDS = 1 << 20
#: Encoded pieces that a worker remembers, and those of the texts at hand.
CACHE = 600_000
MAGIC = b"ACV1"
HEADER = struct.Struct("<4sIQQ")  # magic, documents, values, data bytes

#: Control byte: the lengths of its four values.
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


# --- the byte code ---------------------------------------------------------------------------------------------
def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    size = np.ones(len(values), np.uint8)
    for limit in (0xFF, 0xFFFF, 0xFFFFFF):
        size += values > limit
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    wide = int(size.max(initial=1))  # no value has more bytes
    used = np.arange(wide, dtype=np.uint8) < size[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[:, :wide][used].tobytes()


def unpack_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    end = np.cumsum(size, dtype=np.int64)
    flat = np.frombuffer(data + bytes(4), np.uint8)
    out = flat[end - size].astype("<u4")
    for place in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > place)
        out[more] |= flat[end[more] - size[more] + place].astype("<u4") << np.uint32(8 * place)
    return out


def pack(lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    """A block: header, then the documents' lengths and the ranks as one run of values."""
    values = np.concatenate([np.asarray(lengths, np.uint32), np.asarray(ranks, np.uint32)])
    control, data = pack_values(values)
    return HEADER.pack(MAGIC, len(lengths), len(values), len(data)) + control + data


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A block's lengths and ranks."""
    magic, documents, n, size = HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    cut = HEADER.size + -(-n // 4)
    values = unpack_values(block[HEADER.size : cut], block[cut : cut + size], n)
    return values[:documents], values[documents:]


# --- encoding --------------------------------------------------------------------------------------------------
@lru_cache(maxsize=2)
def _coder(path: str):
    """The tokenizer, its model behind blanks alone (for plain pieces), the ids that close a word, and the pieces met lately."""
    from tokenizers import Tokenizer, pre_tokenizers

    coder, model = Tokenizer.from_file(path), Tokenizer.from_file(path)
    model.normalizer = None
    model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    closes = np.zeros(coder.get_vocab_size() + 1, bool)
    closes[[i for token, i in coder.get_vocab().items() if token.endswith("</w>")]] = True
    return coder, model, closes, {}


#: A text without these has only ASCII and Latin letters, which are lower-cased one by one and are composed.
_OTHER = re.compile(r"[^\x00-\x7FÀ-ÖØ-öø-ÿ]")
#: The vocabulary's pre-tokens in such a text, after lower-casing. Its blanks are space and tab to carriage return.
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\x20\x09-\x0Da-zß-öø-ÿ0-9]+")
#: Pre-tokens that the normalizer leaves as they are and that stand between blanks as they do in a text.
_PLAIN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+")


def pieces(text: str) -> list[str]:
    """Parts of the text whose ids in order are the text's: no token of this vocabulary crosses their borders.

    Plain Latin text is cut into pre-tokens. Other text, or one that could hold a special token, is cut at
    blanks, which the vocabulary drops, and the tokenizer does the rest.
    """
    if "<|" in text or not text.isascii() and _OTHER.search(text):
        return text.replace("\n", " ").split(" ")
    return _PIECE.findall(text.lower())


def _coded(words: list[str], path: str) -> list[bytes]:
    """The ids of distinct pieces. Each is encoded once and remembered; beyond CACHE pieces, the last words alone are."""
    coder, model, closes, known = _coder(path)
    kind = f"<u{id_bytes(path)}"
    new = [w for w, ids in zip(words, map(known.get, words), strict=True) if ids is None]
    plain, rest = [w for w in new if _PLAIN.fullmatch(w)], [w for w in new if not _PLAIN.fullmatch(w)]
    for start in range(0, len(plain), 200):  # each ends with the one id that closes a word
        part = plain[start : start + 200]
        row = np.array(model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, kind)
        ends = ((np.flatnonzero(closes[row]) + 1) * row.itemsize).tolist()
        if len(ends) != len(part):
            rest += part
            continue
        row = row.tobytes()
        known.update(zip(part, [row[a:b] for a, b in zip([0, *ends], ends)], strict=True))  # noqa: B905
    for start in range(0, len(rest), 2000):
        part = rest[start : start + 2000]
        for w, e in zip(part, coder.encode_batch_fast(part, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, kind).tobytes()
    found = list(map(known.__getitem__, words))
    if len(known) > CACHE:
        known.clear()
        known.update(zip(words, found, strict=True))
    return found


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned integers of id_bytes(path) bytes.

    Pieces are numbered, each distinct one is encoded once, and numpy puts the ids of all pieces in a row.
    """
    split = [pieces(t) for t in texts]
    numbered = pa.array(list(chain.from_iterable(split)), pa.string()).dictionary_encode()
    number = numbered.indices.to_numpy()
    width = id_bytes(path)
    ids = _coded(numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), path)
    length = np.fromiter(map(len, ids), np.int64, len(ids)) // width
    size = length[number]
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat((np.cumsum(length) - length)[number] - ends[:-1], size)
    row = np.frombuffer(b"".join(ids), f"<u{width}")[at]
    cuts = ends[np.cumsum([0, *map(len, split)])].tolist()
    return [row[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]  # noqa: B905


def id_bytes(path: str) -> int:
    return 2 if _coder(path)[0].get_vocab_size() <= 1 << 16 else 4


def _encode(path: str, end: int):
    """doc_id and ids of each document; last, on a row of its own, how often each id came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, kind = end.to_bytes(id_bytes(path), "little"), f"<u{id_bytes(path)}"
        total = np.zeros(max(_coder(path)[0].get_vocab_size(), end + 1), np.int64)
        for batch in rows_of(batches, 3 << 20):
            ids = [x + tail for x in encode_texts(batch.column("_text").to_pylist(), path)]
            total += np.bincount(np.frombuffer(b"".join(ids), kind), minlength=len(total))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], ["doc_id", "_ids", "_counts"])
        last = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(last, ["doc_id", "_ids", "_counts"])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            total = sum(np.frombuffer(c, np.int64) for c in batch.column("_counts").to_pylist())
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(total[ids])], ["id", "n"])


def _blocks(ranked, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part = ranked.value, TaskContext.get().partitionId()
        rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
        rank[ids] = np.arange(len(ids), dtype=np.uint32)
        docs, held, size, number, inside = [], [], 0, 0, 0

        def block():
            lengths = np.array([len(x) for x in held], np.uint32)
            body = pack(lengths, np.concatenate(held))
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([inside], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([int(lengths.sum())], pa.int64()), pa.array([body], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "block", "inside", "doc_ids", "n_ids", "body"])

        for batch in rows_of(batches):
            for doc, packed in zip(batch.column("doc_id").to_pylist(), batch.column("_ids").to_pylist(), strict=True):
                held.append(rank[np.frombuffer(packed, kind)])
                docs.append(doc)
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield block()
                    docs, held, size, number, inside = [], [], 0, number + 1, inside + size
        if held:
            yield block()

    return run


def write(docs: DataFrame, path: str, vocabulary: str, text: str = "text", end: int = END_ID) -> DataFrame:
    """Writes the ids of docs under path: blocks in ascending doc_id order, and the ranks beside them.

    Nulls of doc_id come first, equal doc_ids are ordered by their ids' hash (xxhash64). A null text is empty and has the end id
    alone. The rank table has a row for each id that occurs, at most the vocabulary. Returns the blocks, reread.
    """
    spark = docs.sparkSession
    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("_text"))
    coded = materialize(coded.transform(mapped, _encode(vocabulary, end), "doc_id long, _ids binary, _counts binary"), "ids", "snappy")
    kind = f"<u{id_bytes(vocabulary)}"
    counts = coded.where("_counts IS NOT NULL").select("_counts").transform(mapped, _counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranks = np.array([r[0] for r in counts.orderBy(F.desc("n"), "id").select("id").collect()], np.int64)
    spark.createDataFrame([(int(i),) for i in ranks], "id long").coalesce(1).write.parquet(f"{path}/ranks")
    shared = spark.sparkContext.broadcast(ranks)
    ordered = coded.where("_ids IS NOT NULL").select("doc_id", "_ids").withColumn("_hash", F.xxhash64("_ids"))
    # the ids' hash spreads a doc_id that many rows have
    ordered = ordered.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "_ids").drop("_hash")
    schema = "part int, block int, inside long, doc_ids array<long>, n_ids long, body binary"
    ordered.transform(mapped, _blocks(shared, kind), schema).write.option("compression", "none").parquet(f"{path}/blocks")
    return spark.read.schema(schema).parquet(f"{path}/blocks")


def _decode(ranked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ranked.value.astype("<u4")
        for batch in rows_of(batches):
            for docs, start, body in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "_start", "body")), strict=True):
                lengths, ranks = unpack(body)
                flat, ends = ids[ranks], np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                view = memoryview(flat.tobytes())
                sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(docs, pa.int64()), pa.array(starts + start), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def scan(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document under path."""
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))  # a row for each partition of the writer
    before = F.coalesce(F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("part").alias("_part"), before.alias("_before"))
    placed = blocks.join(F.broadcast(parts), F.col("part") == F.col("_part")).withColumn("_start", F.col("_before") + F.col("inside"))
    ids = np.array([r[0] for r in spark.read.parquet(f"{path}/ranks").select("id").collect()], np.int64)
    shared = spark.sparkContext.broadcast(ids)
    return placed.select("doc_ids", "_start", "body").transform(mapped, _decode(shared), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write(read(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    return scan(spark, path)
