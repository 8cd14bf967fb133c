"""Near copies by their words: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

The method is that of simhash (deletion-variant signatures, equality join, verification) with a longer fingerprint.
At a similarity of 0.8 two fingerprints differ in 15 % of their bits, so no cut into few segments bounds a
segment's difference; each segment of 24 bits differs in one bit at most with a probability of 0.11 there (0.17 at
0.85, 0.27 at 0.9, 0.5 at 0.95), and one of 16 is enough.

1. Texts that are equal are one node. A node's index rows are its segments as they are and with one set bit deleted.
2. Rows are sorted by value. A row stays if another one of its value is near in 64 further bits of the fingerprint,
   which go with it: of texts that have nothing in common but a segment's number one in 600 stays, so what stays
   grows with the near copies and not with the square of the input.
3. What meets under a value is compared by whole fingerprints. Of the pairs within LOOSE bits, those of a minimum
   spanning forest are kept: as many as there are nodes, never all pairs.
4. Pairs within SURE bits are links; the others are links if their shingles say so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import kept, mapped, materialize, rows_of, whole_text
from acervo.llm.components import components
from acervo.llm.simhash import LOWER

SHINGLE = 5
SIMILARITY = 0.8
SEGMENTS = 16
SEGMENT_BITS = 24
BITS = SEGMENTS * SEGMENT_BITS
#: 0.8 means 58 bits on average, with a deviation of 7; 0.9 means 40.
SURE, LOOSE = 36, 76
#: The same of 64 bits: 10 on average at 0.8, with a deviation of 3; 32 for texts that have nothing in common.
LOOSE_WORD = 21
#: Nodes under one value that a task compares; more are dealt into parts, and every two parts meet in a task.
CROWD = 4096
BLOCK = 1024
_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


# --- shingles and fingerprints ---------------------------------------------------------------------------------
class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_hash_of = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending; words are lower-cased (A-Z) and end at ASCII blanks.

    A text of fewer words has one shingle, all of them; one without words has none.
    """
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    one = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total = total * np.uint64(_GOLDEN) + one[i : i + n]
    return np.unique(_mix(total))


def fingerprint(found: np.ndarray) -> bytes:
    """BITS bits: each is set if it is set in over half of the shingles' hashes; without shingles none is."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(found), 1 << 14):
        part = found[start : start + (1 << 14)]
        wide = np.stack([_mix(part + np.uint64(_GOLDEN * (i + 1) & _MASK)) for i in range(BITS // 64)], axis=1)
        for at in range(0, len(part), 255):  # counts of 255 rows fit in a byte
            ones += np.unpackbits(wide[at : at + 255].view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found)).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all distinct shingles; two texts without words are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        found = [fingerprint(shingles(t)) for t in batch.column("_text").to_pylist()]
        names = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found, pa.binary())], [*names, "_fp"])


# --- candidates ------------------------------------------------------------------------------------------------
def _segments(fps: list[bytes]) -> np.ndarray:
    """Each fingerprint's segments as numbers."""
    octets = np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), SEGMENTS, 3).astype(np.int32)
    return octets[:, :, 0] << 16 | octets[:, :, 1] << 8 | octets[:, :, 2]


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows: a segment's number is in the value's high bits."""
    bits = np.int32(1) << np.arange(SEGMENT_BITS, dtype=np.int32)
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            nodes, fps = part.column("node").to_numpy(), part.column("fp").to_pylist()
            seg, words = _segments(fps), np.frombuffer(b"".join(fps), np.int64).reshape(len(fps), -1)
            further = words[:, (np.arange(SEGMENTS) * 3 // 8 + 3) % words.shape[1]]  # the word half a fingerprint away
            tag = (np.arange(SEGMENTS, dtype=np.int32) << SEGMENT_BITS)[None, :]
            row, place, bit = np.nonzero((seg[:, :, None] & bits) != 0)
            deleted = (seg[row, place] ^ bits[bit]) | tag[0, place]
            values = np.concatenate([(seg | tag).ravel(), deleted])
            owners = np.concatenate([np.repeat(nodes, SEGMENTS), nodes[row]])
            own = np.concatenate([np.ones(seg.size, bool), np.zeros(len(row), bool)])
            check = np.concatenate([further.ravel(), further[row, place]])
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int32()), pa.array(owners), pa.array(own), pa.array(check)], ["value", "node", "own", "further"])


def _near_one(words: np.ndarray) -> np.ndarray:
    """Which of some words have another one within LOOSE_WORD bits."""
    out = np.zeros(len(words), bool)
    for a in range(0, len(words), BLOCK):
        for b in range(a, len(words), BLOCK):
            left, right = words[a : a + BLOCK], words[b : b + BLOCK]
            near = np.bitwise_count(left[:, None] ^ right[None, :]) <= LOOSE_WORD
            if a == b:
                np.fill_diagonal(near, False)
            out[a : a + BLOCK] |= near.any(axis=1)
            out[b : b + BLOCK] |= near.any(axis=0)
    return out


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows near another one of their value, where one is own; rows come sorted by value, own ones first.

    Of a value with more than CROWD rows all stay.
    """
    held: list[np.ndarray] = []  # the last value's rows so far
    crowd, stays = -1, False  # a crowded value, whose rows are not held, and whether it has an own row

    def near(value, node, own, word) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        sizes = np.diff(starts, append=len(value))
        out = np.zeros(len(value), bool)
        two = starts[(sizes == 2) & own[starts]]
        two = two[np.bitwise_count(word[two] ^ word[two + 1]) <= LOOSE_WORD]
        out[two] = out[two + 1] = True
        many = (sizes > 2) & own[starts]
        for s, n in zip(starts[many].tolist(), sizes[many].tolist(), strict=True):
            out[s : s + n] = n > CROWD or _near_one(word[s : s + n])
        return rows(value[out], node[out])

    def rows(value, node) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(value, pa.int32()), pa.array(node, pa.int64())], ["value", "node"])

    for batch in batches:
        part = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("value", "node", "own", "further")]
        part[3] = part[3].view(np.uint64)  # the count of a negative number's bits is that of its absolute value
        same = int(np.searchsorted(part[0], crowd, "right")) if crowd >= 0 else 0
        if same and stays:
            yield rows(part[0][:same], part[1][:same])
        part = [c[same:] for c in part]
        if held:
            part = [np.concatenate(c) for c in zip(held, part, strict=True)]
        if not len(part[0]):
            continue
        last = int(np.searchsorted(part[0], part[0][-1], "left"))
        if last:
            yield near(*(c[:last] for c in part))
        held = [c[last:] for c in part]
        if len(held[0]) > CROWD:
            crowd, stays = int(held[0][0]), bool(held[2][0])
            if stays:
                yield rows(*held[:2])
            held = []
    if held:
        yield near(*held)


def _tree(n: int, edges: Iterator[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of edges (i, j, bits) in order of bits those that connect what was not connected yet."""
    parent, tree = list(range(n)), []
    for i, j, bits in edges:
        a, b = i, j
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[max(a, b)] = min(a, b)
            tree.append((i, j, bits))
            if len(tree) == n - 1:
                break
    return tree


def forest(fps: np.ndarray, loose: int = LOOSE) -> list[tuple[int, int, int]]:
    """A minimum spanning forest (i, j, bits) of the pairs within loose bits; fps has a row of 64-bit words for each node."""
    found: list[tuple[int, int, int]] = []
    for a in range(0, len(fps), BLOCK):
        for b in range(a, len(fps), BLOCK):
            left, right = fps[a : a + BLOCK], fps[b : b + BLOCK]
            bits = np.zeros((len(left), len(right)), np.uint16)
            for word in range(fps.shape[1]):
                bits += np.bitwise_count(left[:, None, word] ^ right[None, :, word])
            i, j = np.nonzero(bits <= loose)
            if a == b:
                i, j = i[i < j], j[i < j]
            order = np.argsort(bits[i, j], kind="stable")
            i, j = i[order], j[order]
            found += _tree(len(fps), zip((i + a).tolist(), (j + b).tolist(), bits[i, j].tolist(), strict=True))
    return _tree(len(fps), iter(sorted(found, key=lambda e: e[2]))) if len(fps) > BLOCK else found


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of each value's nodes; rows come sorted by value, part and other."""
    held: list[tuple] = []
    kinds = (pa.int64(), pa.int64(), pa.int32())

    def pairs(groups: list[tuple]) -> pa.RecordBatch:
        key, node, fps = (np.concatenate(x) for x in zip(*groups, strict=True))
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        starts, ends = np.append(0, cut), np.append(cut, len(key))
        two = starts[ends - starts == 2]
        bits = np.bitwise_count(fps[two] ^ fps[two + 1]).sum(axis=1)
        two, bits = two[bits <= LOOSE], bits[bits <= LOOSE]
        a, b, h = [node[two]], [node[two + 1]], [bits]
        for s, t in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            tree = np.array(forest(fps[s:t]), np.int64).reshape(-1, 3)
            a.append(node[s:t][tree[:, 0]])
            b.append(node[s:t][tree[:, 1]])
            h.append(tree[:, 2])
        a, b = np.concatenate(a), np.concatenate(b)
        columns = (np.minimum(a, b), np.maximum(a, b), np.concatenate(h))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "bits"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(c).to_numpy() for c in ("value", "part", "other")])
        fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        rows = (key, batch.column("node").to_numpy(), fps)
        if held and (held[-1][0][-1] != key[0]).any():
            yield pairs(held)
            held = []
        ends = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        if len(ends):
            held.append(tuple(x[: ends[-1]] for x in rows))
            yield pairs(held)
            held = [tuple(x[ends[-1] :] for x in rows)]
        else:
            held.append(rows)
    if held:
        yield pairs(held)


def candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) that meet and lie within LOOSE bits, with their bits."""
    index = nodes.select("node", "fp").transform(mapped, _variants, "value int, node long, own boolean, further long")
    index = index.repartition("value").sortWithinPartitions("value", F.desc("own"), "node")
    shared = materialize(index.transform(mapped, _shared, "value int, node long"), "shared")
    crowds = shared.groupBy("value").agg(F.ceil(F.count("*") / F.lit(CROWD // 2)).cast("int").alias("_parts")).where(F.col("_parts") > 2)
    rows = shared.join(crowds, "value", "left").join(nodes.select("node", "fp"), "node")
    # a crowded value's nodes are dealt into parts, and a row goes wherever its part meets one
    parts = F.coalesce("_parts", F.lit(1))
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    rows = rows.select("value", "node", "fp", own.alias("_own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_with"))
    rows = rows.select("value", F.least("_own", "_with").alias("part"), F.greatest("_own", "_with").alias("other"), "node", "fp")
    met = rows.repartition("value", "part", "other").sortWithinPartitions("value", "part", "other", "node")
    return met.transform(mapped, _met, "a long, b long, bits int").groupBy("a", "b").agg(F.min("bits").alias("bits"))


# --- links -----------------------------------------------------------------------------------------------------
def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        found = [shingles(t).tobytes() for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "shingles"])


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            sides = zip(batch.column("_left").to_pylist(), batch.column("_right").to_pylist(), strict=True)
            near = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in sides]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def links(nodes: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of nodes whose shingles are alike; texts has key and _text, nodes has node, key and fp."""
    pairs = materialize(candidates(nodes), "pairs")
    open_ = pairs.where(F.col("bits") > SURE)
    asked = open_.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "key"), "node")
    sets = texts.join(asked, "key").dropDuplicates(["node"]).select("node", "_text").transform(mapped, _shingled, "node long, shingles binary")
    sets = materialize(sets, "shingles")
    side = lambda name, column: sets.select(F.col("node").alias(name), F.col("shingles").alias(column))
    checked = open_.join(side("a", "_left"), "a").join(side("b", "_right"), "b").select("a", "b", "_left", "_right")
    checked = checked.transform(mapped, _alike(least), "a long, b long")
    return pairs.where(F.col("bits") <= SURE).select("a", "b").unionByName(checked)


def classes(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = SIMILARITY) -> DataFrame:
    """keep's columns with _root, for every row of docs: rows with one _root hang together by links.

    A null text is empty, and texts without words are alike. Equal texts are one node, however many rows have them.
    """
    keep = kept(keep, ())
    source = docs.select(*keep, F.unhex(F.sha2(whole_text(text), 256)).alias("_key"), whole_text(text).alias("_text"))
    schema = source.drop("_text").schema.add("_fp", "binary")
    rows = materialize(source.transform(mapped, _fingerprints, schema), "wide")
    nodes = rows.groupBy(F.col("_key").alias("key")).agg(F.first("_fp").alias("fp")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(nodes, "nodes")
    roots = components(links(nodes, source.select(F.col("_key").alias("key"), "_text"), least)).withColumnRenamed("node", "_node")
    placed = nodes.join(roots, F.col("node") == F.col("_node"), "left").select(F.col("key").alias("_placed"), F.coalesce("root", "node").alias("_root"))
    return rows.join(placed, F.col("_key") == F.col("_placed")).select(*keep, "_root")
