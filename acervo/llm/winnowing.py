"""Document fingerprints by winnowing.

Every k-gram of code points has a rolling hash; in each window of w hashes the least is chosen, the rightmost
of equal ones, and its position is kept. Two texts that share a passage of w + k - 1 code points share a chosen
hash inside it. Hash and position share one 64-bit word (40 bits of hash above 24 bits of inverted position), so
that one running minimum finds the choice of every window; longer texts are taken in blocks whose positions
count from the block's start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from acervo.llm.common import kept, mapped, materialize, read, rows_of, whole_text

K = 24
WINDOW = 27
_POSITION_BITS = np.uint64(24)
_BLOCK = 1 << 22
_BASE = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


# --- fingerprints ----------------------------------------------------------------------------------------------
def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """The 40-bit hash of every k-gram: a polynomial in the code points, built by doubling, then mixed."""
    span, total = 1, points.astype(np.uint64) + np.uint64(1)
    base, out, out_span = _BASE, None, 0
    while True:
        if k & span:
            if out is None:
                out, out_span = total, span
            else:  # the part so far, then this one
                n = len(points) - out_span - span + 1
                out = out[:n] * np.uint64(base) + total[out_span : out_span + n]
                out_span += span
        if span * 2 > k:
            break
        n = len(total) - span
        total = total[:n] * np.uint64(base) + total[span:]
        base, span = base * base & _WORD, span * 2
    out = out ^ (out >> np.uint64(31))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    out = out ^ (out >> np.uint64(27))
    out = out * np.uint64(0x94D049BB133111EB)
    return out >> np.uint64(24)


def window_minimum(values: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = w - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The chosen hashes and their positions, ascending.

    A text shorter than k has one gram, the whole text; one with fewer hashes than a window has one window.
    The empty text has none.
    """
    points = code_points(text)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(k, len(points))
    grams = len(points) - k + 1
    window = min(window, grams)
    hashes, places = [], []
    for start in range(0, grams - window + 1, _BLOCK):
        stop = min(start + _BLOCK, grams - window + 1) + window - 1  # of the grams that these windows have
        h = gram_hashes(points[start : stop + k - 1], k)
        inverted = (np.uint64(1) << _POSITION_BITS) - np.uint64(1) - np.arange(len(h), dtype=np.uint64)
        least = window_minimum(h << _POSITION_BITS | inverted, window)
        least = least[np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))]
        at = (np.uint64(1) << _POSITION_BITS) - np.uint64(1) - (least & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1)))
        hashes.append(least >> _POSITION_BITS)
        places.append(at.astype(np.int64) + start)
    hashes, places = np.concatenate(hashes), np.concatenate(places)
    places, first = np.unique(places, return_index=True)  # neighbouring blocks may choose the same place
    return hashes[first], places


def digest(hashes: np.ndarray, places: np.ndarray) -> str:
    """A short name of a fingerprint: equal fingerprints, positions included, have equal names."""
    body = hashlib.sha256(hashes.astype("<u8").tobytes())
    body.update(places.astype("<i8").tobytes())
    return body.hexdigest()[:32]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all distinct hashes of two fingerprints; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def _listed(k: int, window: int):
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("position", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = [winnow(t, k, window) for t in batch.column("_text").to_pylist()]
            offsets = np.cumsum([0, *(len(h) for h, _ in found)]).astype(np.int32)
            flat = [np.concatenate([x[i] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64) for i in (0, 1)]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x) for x in flat], names=["hash", "position"]))
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], lists.cast(kind)], [*names, "fingerprint"])

    return run


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns with fingerprint: the chosen (hash, position) pairs in order; a null text has none.

    Clashing names follow common.kept.
    """
    keep = kept(keep, ("fingerprint",))
    schema = docs.select(*keep).schema.add("fingerprint", ArrayType(StructType().add("hash", "long").add("position", "long")))
    return docs.select(*keep, whole_text(text).alias("_text")).transform(mapped, _listed(k, window), schema)


# --- each document against its edited text and its neighbour ----------------------------------------------------
def edited(text: str, following: str) -> str:
    """The last quarter of the text (rounded down) replaced by as much of the following text's start."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _row(doc, text: str, own, following: str, other) -> tuple:
    changed = edited(text, following)
    new = winnow(changed)
    return (doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), digest(*own), digest(*new), likeness(own[0], new[0]), likeness(own[0], other[0]), len(own[0]))


_FOUND = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_hashes"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
FOUND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes long"
EDGE = "part int, head boolean, text string"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the partition's documents but the last; the first and last document's texts go to the edges."""
    part, last = TaskContext.get().partitionId(), None

    def out(rows: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows] + [e[0] for e in edges] * (i == 0) + [None] * (len(edges) * (i > 0)), t) for i, t in enumerate(_TYPES)]
        side = [[None] * len(rows) + [e[i] for e in edges] for i in (1, 2, 3)]
        columns += [pa.array(side[0], pa.int32()), pa.array(side[1], pa.bool_()), pa.array(side[2], pa.string())]
        return pa.RecordBatch.from_arrays(columns, [*_FOUND, "part", "head", "text"])

    for batch in rows_of(batches):
        rows, edges = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("_text").to_pylist(), strict=True):
            own = winnow(text)
            if last is None:
                edges.append((doc, part, True, text))
            else:
                rows.append(_row(*last, text, own))
            last = (doc, text, own)
        yield out(rows, edges)
    if last is not None:
        yield out([], [(last[0], part, False, last[1])])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        rows = [_row(doc, text, winnow(text), after, winnow(after)) for doc, text, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after")), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _FOUND)


def against_neighbours(docs: DataFrame, text: str = "text") -> DataFrame:
    """For each document its fingerprint, that of its edited text and the likeness to both it and the next document.

    The next document has the next doc_id, and the first follows the last; a lone document follows itself. Null
    doc_ids come first, and equal ones are ordered by their text's hash (xxhash64), then the text. Texts are dealt out in ranges of doc_id; only
    a range's first and last text leave it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("_text"))
    # the text's hash spreads a doc_id that many rows have; equal texts come together, and their order is that of the hash
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    ordered = rows.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "_text").drop("_hash")
    done = materialize(ordered.transform(mapped, _neighbours, f"{FOUND}, {EDGE}"), "winnowed")
    inner = done.where("part IS NULL").select(*_FOUND)
    edges = done.where("part IS NOT NULL")
    parts = sorted(r[0] for r in edges.select("part").distinct().collect())  # as many as the ranges
    after = dict(zip(parts, [*parts[1:], *parts[:1]], strict=True))
    lookup = docs.sparkSession.createDataFrame(list(after.items()), "_part int, _after int")
    tails = edges.where("NOT head").join(F.broadcast(lookup), F.col("part") == F.col("_part")).select("doc_id", "text", "_after")
    heads = edges.where("head").select(F.col("part").alias("_head"), F.col("text").alias("after"))
    outer = tails.join(heads, F.col("_after") == F.col("_head")).select("doc_id", "text", "after").transform(mapped, _pairs, FOUND)
    return inner.unionByName(outer)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_neighbours(read(spark, sf_dir, "documents"))
