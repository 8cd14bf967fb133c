"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Fingerprints that differ in at most three bits have a
segment in which they differ in at most one, so an equality join of segments with their one-bit variants meets
every link. Of a one-bit difference one side has the bit set and the other not: it is enough to index each
segment as it is and, for every set bit, with that bit deleted; then a link's two sides meet under the value
that both have without the bit. What meets is verified by its whole Hamming distance.

Only distinct fingerprints are indexed. What meets under one value is not turned into all pairs: a task holds
the value's fingerprints in blocks, verifies block against block and keeps the links of a spanning forest. A
value that very many fingerprints share is first split by the bytes of the other segment, of which any two
linked fingerprints have one in common, and then into parts by hash, every two of which meet in a task: no task
holds more than some multiple of SPLIT fingerprints, whatever the value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm.common import WORD, kept, mapped, materialize, read, rows_of, whole_text
from acervo.llm.components import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Fingerprints under one index value from which on it is split by the other segment's bytes, and those of a part.
SPLIT = 20_000
PART = 160_000
#: Side of the blocks that are compared at a time.
BLOCK = 1024

_WORD = re.compile(WORD.encode())
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# --- fingerprints ----------------------------------------------------------------------------------------------
def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the hashes of the text's word shingles, repeats counted."""
    words = text.encode().translate(LOWER).split()  # bytes: splits at ASCII blanks alone
    if not words:
        return 0
    whole = b" ".join(words)
    n = len(words) - shingle + 1
    if n < 2:
        return xxhash.xxh64_intdigest(whole, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(lengths + 1) - 1
    starts, ends = (end - lengths)[:n].tolist(), end[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends, strict=True)], ">u8")
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        found = np.array([fingerprint(t) for t in batch.column("_text").to_pylist()], np.uint64).view(np.int64)
        names = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found)], [*names, "_fp"])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns with _fp (the fingerprint as a signed long); a null text is empty and has zero.

    Clashing names follow common.kept.
    """
    keep = kept(keep, ())
    schema = docs.select(*keep).schema.add("_fp", "long")
    return docs.select(*keep, whole_text(text).alias("_text")).transform(mapped, _fingerprints, schema)


# --- links -----------------------------------------------------------------------------------------------------
def _bits(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)


class _Forest:
    """Union-find over a value's fingerprints."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unites the ends of each link."""
        while len(a):
            root = self.roots()
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def forest(values: np.ndarray, exact: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect the distinct values as all links of at most distance bits would, where one end is exact.

    Links of one bit are found by sorting, as a value and its neighbours; what these connect is one group, and
    only values of different groups are compared, smaller groups against all.
    """
    n = len(values)
    found = _Forest(n)
    if n > 2 * BLOCK:
        order = np.argsort(values)
        ranked = values[order]
        for bit in range(64):
            mate = ranked ^ np.uint64(1 << bit)
            at = np.minimum(np.searchsorted(ranked, mate), n - 1)
            hit = np.flatnonzero((ranked[at] == mate) & (mate > ranked))
            found.join(order[hit], order[at[hit]])
    root = found.roots()
    sizes = np.bincount(root, minlength=n)
    rows = np.argsort(sizes[root], kind="stable")  # small groups first; the largest need not meet itself
    rest = rows[root[rows] != np.argmax(sizes)] if n > 2 * BLOCK else rows
    for start in range(0, len(rest), BLOCK):
        left = rest[start : start + BLOCK]
        for other in range(0, n, BLOCK):
            right = rows[other : other + BLOCK]
            near = (_bits(values[left][:, None] ^ values[right][None, :]) <= distance) & (exact[left][:, None] | exact[right][None, :])
            i, j = np.nonzero(near)
            if len(i):
                found.join(left[i], right[j])
    root = found.roots()
    ends = np.flatnonzero(root != np.arange(n))
    return ends, root[ends]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the rows of each index value; rows come sorted by value, an own row before variants."""
    key, fps, exact = [np.zeros(0, np.int64)] * 2, np.zeros(0, np.uint64), np.zeros(0, bool)
    held: list[tuple] = []

    def links(k1, k2, v, e):
        """Within whole runs of equal keys."""
        cut = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(k1)]])
        size = ends - starts
        owns = np.add.reduceat(e.astype(np.int64), starts)
        out_a, out_b = [], []
        pairs = starts[(size == 2) & (owns > 0)]
        near = pairs[_bits(v[pairs] ^ v[pairs + 1]) <= DISTANCE]
        out_a.append(v[near])
        out_b.append(v[near + 1])
        for s, t in zip(starts[(size > 2) & (owns > 0)].tolist(), ends[(size > 2) & (owns > 0)].tolist(), strict=True):
            a, b = forest(v[s:t], e[s:t])
            out_a.append(v[s:t][a])
            out_b.append(v[s:t][b])
        a, b = np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2 = batch.column("value").to_numpy(), batch.column("part").to_numpy()
        v, e = batch.column("fp").to_numpy().view(np.uint64), batch.column("own").to_numpy(zero_copy_only=False)
        ends = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
        if held and (held[-1][0][-1] != k1[0] or held[-1][1][-1] != k2[0]):
            yield links(*map(np.concatenate, zip(*held, strict=True)))
            held = []
        if len(ends):
            last = int(ends[-1])
            held.append((k1[:last], k2[:last], v[:last], e[:last]))
            yield links(*map(np.concatenate, zip(*held, strict=True)))
            held = [(k1[last:], k2[last:], v[last:], e[last:])]
        else:
            held.append((k1, k2, v, e))
    if held:
        yield links(*map(np.concatenate, zip(*held, strict=True)))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of distinct fingerprints: each segment as it is, and with one set bit deleted."""
    bits = np.uint64(1) << np.arange(32, dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for start in range(0, len(fps), 4096):
            part = fps[start : start + 4096]
            values, owners, own = [], [], []
            for segment in range(2):
                seg = (part >> np.uint64(32 * segment)) & low
                tag = np.uint64(segment << 32)
                values += [seg | tag]
                owners += [part]
                own += [np.ones(len(part), bool)]
                i, j = np.nonzero((seg[:, None] & bits) != 0)
                values += [(seg[i] ^ bits[j]) | tag]
                owners += [part[i]]
                own += [np.zeros(len(i), bool)]
            columns = [pa.array(np.concatenate(values).view(np.int64)), pa.array(np.concatenate(owners).view(np.int64)), pa.array(np.concatenate(own))]
            yield pa.RecordBatch.from_arrays(columns, ["value", "fp", "own"])


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) of the distinct fingerprints fp that connect them as all links of DISTANCE bits would."""
    index = distinct.select("fp").transform(mapped, _variants, "value long, fp long, own boolean")
    index = materialize(index, "variants")
    counts = index.groupBy("value").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).where("any_own AND n > 1")
    counts = counts.select("value", (F.col("n") > SPLIT).alias("hot"), F.ceil(F.col("n") / PART).cast("int").alias("_parts"))
    index = index.join(counts, "value")
    other = F.when(F.col("value") < 1 << 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp")).bitwiseAND(F.lit((1 << 32) - 1))
    split = F.array(*[(F.shiftrightunsigned(other, 8 * i).bitwiseAND(F.lit(255)) + 1 + 256 * i).cast("int") for i in range(4)])
    index = index.withColumn("_byte", F.explode(F.when(F.col("hot"), split).otherwise(F.array(F.lit(0)))))
    # a part's rows go wherever it meets another part
    own = F.pmod(F.xxhash64("fp"), "_parts").cast("int")
    index = index.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("_own", own)
    meeting = F.least("_own", "_with").cast("long") * (1 << 20) + F.greatest("_own", "_with")
    index = index.select("value", (meeting * 2048 + F.col("_byte")).alias("part"), "fp", "own")
    ordered = index.repartition("value", "part").sortWithinPartitions("value", "part", F.desc("own"), "fp")
    return ordered.transform(mapped, _met, "a long, b long")


def classes(rows: DataFrame, id_column: str = "doc_id", root: bool = False) -> DataFrame:
    """rows (with _fp) and component_id: the smallest id that links reach, itself included.

    A column component_id of rows is replaced. Equal fingerprints are linked. Null ids are never a component's id unless it has no other. Where an id stands
    in several components they can have it in common; _root, which root adds, tells them apart.
    """
    rows = materialize(rows.drop("component_id", "_root"), "fingerprints")
    distinct = rows.groupBy(F.col("_fp").alias("fp")).agg(F.min(id_column).alias("_least"))
    roots = components(links(distinct))
    placed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root"))
    placed = materialize(placed, "roots")
    least = placed.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = placed.join(least, "_root").select(F.col("fp").alias("_named"), "component_id", *["_root"] * root)
    return rows.join(named, F.col("_fp") == F.col("_named")).drop("_named")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(fingerprints(read(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
