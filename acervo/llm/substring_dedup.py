"""Exact removal of repeated byte strings, by suffix arrays over shards.

Bytes that lie in a string of LENGTH bytes that starts anywhere else too are removed. Of every such window the
k-gram with the least hash is its anchor. Equal windows have equal anchors, so a shard that holds all windows of
an anchor holds all their copies, and only anchors that occur twice matter:

1. Every text's anchors are listed; texts that are whole copies of each other count as one.
2. The anchors' hashes are dealt out; those that only one place has are dropped.
3. Each text with anchors left gives, for each, the segment of bytes that the anchor's windows cover.
4. Distinct segments are found before they are dealt out; what recurs byte for byte is marked as a whole. The
   groups of an anchor with over CROWD distinct segments are split by the bytes beside the anchor: two segments with
   a window in common agree in at least 84 bytes before or behind it, so each goes to two smaller groups.
5. A shard gathers whole groups, without the segments that agree with no other of their group over LENGTH bytes around
   the anchor. It builds one suffix array by induced sorting. Where the permuted common prefix of a suffix or its
   successor in the array reaches LENGTH, a window repeats.
6. The windows go back to their texts, which merge them and drop their bytes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm.common import mapped, materialize, read, rows_of, whole_text
from acervo.llm.suffix_array import permuted_prefixes, suffix_array
from acervo.llm.winnowing import gram_hashes, window_minimum

LENGTH = 200
GRAM = 32
#: Distinct segments of an anchor from which on they are split by their surroundings.
CROWD = 256
#: Bytes of distinct segments that a shard gathers before it is sorted; one anchor's group is never divided.
SHARD_BYTES = 1 << 20
_BLOCK = 1 << 22
_PLACE = np.uint64(24)
_MASK = (np.uint64(1) << _PLACE) - np.uint64(1)


# --- anchors ---------------------------------------------------------------------------------------------------
def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, the anchor's hash (signed) and place."""
    first, count, hashes, places = [], [], [], []
    windows = len(data) - length + 1
    raw = np.frombuffer(data, np.uint8)
    for start in range(0, windows, _BLOCK):
        stop = min(start + _BLOCK, windows)
        h = gram_hashes(raw[start : stop + length - 1], gram)
        key = h << _PLACE | np.arange(len(h), dtype=np.uint64)
        least = window_minimum(key, length - gram + 1)
        cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        first.append(cut + start)
        count.append(np.diff(cut, append=len(least)))
        places.append((least[cut] & _MASK).astype(np.int64) + start)
        hashes.append(_whole_hash(raw, places[-1], gram))
    if not first:
        return (np.zeros(0, np.int64),) * 4
    return np.concatenate(first), np.concatenate(count), np.concatenate(hashes), np.concatenate(places)


def _whole_hash(raw: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the grams at these places."""
    out = np.zeros(len(at), np.uint64)
    for i in range(gram):
        out = (out + raw[at + i].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _first_two(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and their numbers, of each hash the first two: a text's own repeats need no more to be seen."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    third = np.zeros(len(order), bool)
    third[2:] = ranked[2:] == ranked[:-2]
    keep = np.sort(order[~third])
    return hashes[keep], keep.astype(np.int32)


def _listed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            texts = [t.encode() for t in batch.column("_text").to_pylist()]
            sha = [hashlib.sha256(t).digest() for t in texts]
            found = [_first_two(anchors(t, length)[2]) for t in texts]
            offsets = pa.array(np.cumsum([0, *(len(h) for h, _ in found)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[i] for x in found]), kind)) for i, kind in ((0, pa.int64()), (1, pa.int32()))]
            columns = [batch.column("doc_id"), pa.array(sha, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sha", "n_bytes", "hashes", "numbers"])

    return run


def _keys(column: pa.Array) -> np.ndarray:
    """Keys of 16 bytes as two numbers each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, those of a hash that two different places have; a hash's first row waits for another."""
    waiting: tuple[int, np.ndarray, int, bool] | None = None  # hash, text, number, whether it is out
    for batch in batches:
        if not batch.num_rows:
            continue
        h, t, i = batch.column("hash").to_numpy(), _keys(batch.column("text_key")), batch.column("number").to_numpy()
        goes_on = waiting is not None and waiting[0] == h[0]
        new = np.append(True, h[1:] != h[:-1])
        runs = np.flatnonzero(new)
        width = np.diff(runs, append=len(h))
        head = np.repeat(runs, width)
        head_t, head_i = t[head], i[head]
        if goes_on:  # the first run's head came earlier
            head_t[: width[0]], head_i[: width[0]] = waiting[1], waiting[2]
        differs = (t != head_t).any(axis=1) | (i != head_i)
        repeats = np.logical_or.reduceat(differs, runs)
        late = goes_on and not waiting[3] and repeats[0]  # the head is out only now
        if goes_on:
            repeats[0] |= waiting[3]
        out = np.repeat(repeats, width)
        keys, numbers = [x.tobytes() for x in t[out]], i[out].astype(np.int32)
        if late:
            keys, numbers = [*keys, waiting[1].tobytes()], np.append(numbers, np.int32(waiting[2]))
        last = runs[-1]
        first = waiting[1:3] if goes_on and len(runs) == 1 else (t[last].copy(), int(i[last]))
        waiting = (int(h[last]), *first, bool(repeats[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(numbers, pa.int32())], ["text_key", "number"])


# --- segments --------------------------------------------------------------------------------------------------
PIECE = "sha binary, text binary, n_copies long, hash long, segment binary, segment_key binary, text_key binary, starts array<long>, anchor long"


def _segments(length: int):
    """For each text a row with its bytes (unless it is removed whole), and a row for each distinct segment of its repeated anchors."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
        names = [part.split()[0] for part in PIECE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("_text", "sha", "n_copies", "text_key", "numbers")
        for batch in rows_of(batches, 1 << 20):
            rows = []
            for text, sha, copies, key, numbers in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                data = text.encode()
                first, count, hashes, places = (x.tolist() for x in anchors(data, length))
                rows.append((sha, data if copies == 1 else None, copies, None, None, None, None, None, None))
                own = Counter(hashes)
                segments: dict[bytes, list] = {}
                for i in sorted({n for n in numbers if n < len(first)} | {n for n, h in enumerate(hashes) if own[h] > 1}):
                    segment = data[first[i] : first[i] + count[i] + length - 1]
                    if segment in segments:
                        segments[segment][1].append(first[i])
                    else:
                        segments[segment] = [i, [first[i]]]
                for segment, (i, starts) in segments.items():
                    rows.append((None, None, copies, hashes[i], segment, hashlib.sha256(segment).digest()[:16], key, starts, places[i] - first[i]))
            yield batch_of(rows)

    return run


def _agreement(parts: list[bytes]) -> list[int]:
    """For each part the most bytes from its start that another one shares; neighbours in order share most."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    best = [0] * len(parts)
    for i, j in zip(order, order[1:]):  # noqa: B905
        n = min(len(parts[i]), len(parts[j]))
        differs = (int.from_bytes(parts[i][:n]) ^ int.from_bytes(parts[j][:n])).bit_length()
        shared = n - (differs + 7) // 8
        best[i], best[j] = max(best[i], shared), max(best[j], shared)
    return best


def candidates(segments: list[bytes], anchor: list[int], length: int = LENGTH) -> list[int]:
    """Of a group's distinct segments those that may share a window: around the anchor, at least length bytes agree with others."""
    after = _agreement([s[a:] for s, a in zip(segments, anchor, strict=True)])
    before = _agreement([s[:a][::-1] for s, a in zip(segments, anchor, strict=True)])
    return [i for i in range(len(segments)) if before[i] + after[i] >= length]


def repeated_windows(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of distinct segments, the starts of its windows that occur in two places of all the segments."""
    sizes = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(sizes + 1) - 1  # a separator behind each
    body = np.zeros(int(sizes.sum()) + len(segments), np.int64)
    inside = np.ones(len(body), bool)
    inside[ends] = False
    body[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 1
    order = suffix_array(body)
    prefix = permuted_prefixes(body, order)
    rank_prefix = prefix[order]
    alike = np.zeros(len(body), bool)
    near = rank_prefix >= length
    alike[order[near]] = True
    alike[order[np.flatnonzero(near) - 1]] = True
    starts = ends - sizes
    left = np.repeat(ends, sizes + 1) - np.arange(len(body))  # bytes before the separator
    alike &= left >= length
    return [np.flatnonzero(alike[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _ranges(places: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive places: (first, last)."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.concatenate([[0], cut + 1])].tolist(), places[np.concatenate([cut, [len(places) - 1]])].tolist(), strict=True))


def _marked(length: int):
    """Repeated windows of each segment; rows (of distinct segments) come sorted by hash and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the shard: segments that need sorting; of the open group: its segments, with the anchor's place
        shard: list[tuple[int, bytes, bytes]] = []
        held = 0
        group: list[tuple[int, bytes, bytes, int]] = []
        current = None
        done: list[tuple[int, bytes, list]] = []  # a row for each segment with repeated windows

        def close_group() -> None:
            nonlocal held, group
            if len(group) > 1:
                for i in candidates([g[2] for g in group], [g[3] for g in group], length):
                    shard.append(group[i][:3])
                    held += len(group[i][2])
            group = []

        def sort_shard() -> None:
            nonlocal shard, held
            if shard:
                for (hash_, key, _), found in zip(shard, repeated_windows([s for _, _, s in shard], length), strict=True):
                    if len(found):
                        done.append((hash_, key, _ranges(found)))
            shard, held = [], 0

        def emit() -> pa.RecordBatch:
            nonlocal done
            ranges = pa.array([[{"first": a, "last": b} for a, b in r[2]] for r in done], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.binary()), ranges], ["hash", "segment_key", "marks"])
            done = []
            return out

        for batch in rows_of(batches):
            for hash_, side, key, segment, anchor in zip(*(batch.column(c).to_pylist() for c in ("hash", "side", "segment_key", "segment", "anchor")), strict=True):
                if (hash_, side) != current:
                    close_group()
                    current = (hash_, side)
                    if held >= SHARD_BYTES:
                        sort_shard()
                group.append((hash_, key, segment, anchor))
            if done:
                yield emit()
        close_group()
        sort_shard()
        if done:
            yield emit()

    return run


def _cleaned(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            out = []
            for sha, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("sha", "text", "ranges")), strict=True):
                edge = np.zeros(len(text) + 1, np.int64)
                flat = np.array([(r["a"], r["b"]) for r in ranges], np.int64).reshape(-1, 2)
                np.add.at(edge, flat[:, 0], 1)
                np.add.at(edge, flat[:, 1] + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                spans = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((sha, int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), [{"first": int(a), "end": int(b)} for a, b in spans]))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], CLEANED_NAMES)

    return run


MARKS = "array<struct<first:bigint,last:bigint>>"
CLEANED_NAMES = ["sha", "n_removed", "n_spans", "kept_sha256", "spans"]
CLEANED = "sha binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:bigint,end:bigint>>"


def _marks(segments: DataFrame, length: int) -> DataFrame:
    """hash, segment_key and marks: where windows start that occur in another place too; one or two rows a segment."""
    repeats = (F.max("n_copies") > 1) | (F.max(F.size("starts")) > 1) | (F.min("text_key") != F.max("text_key"))
    distinct = segments.groupBy("hash", "segment_key").agg(F.first("segment").alias("segment"), F.first("anchor").alias("anchor"), repeats.alias("repeats"))
    distinct = materialize(distinct, "distinct")
    groups = distinct.groupBy("hash").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("hash").alias("_hash"), (F.col("_n") > CROWD).alias("_crowd"))
    beside = (length - GRAM) // 2
    before = F.when(F.col("anchor") >= beside, F.xxhash64(F.lit(1), F.substring("segment", F.col("anchor") - beside + 1, F.lit(beside))))
    behind = F.when(F.length("segment") >= F.col("anchor") + GRAM + beside, F.xxhash64(F.lit(2), F.substring("segment", F.col("anchor") + GRAM + 1, F.lit(beside))))
    sides = F.when(F.col("_crowd"), F.filter(F.array(before, behind), lambda x: x.isNotNull())).otherwise(F.array(F.lit(0).cast("long")))
    dealt = distinct.join(groups, F.col("hash") == F.col("_hash")).select("hash", F.explode(sides).alias("side"), "segment_key", "segment", "anchor")
    dealt = dealt.repartition("hash", "side").sortWithinPartitions("hash", "side")
    marks = dealt.transform(mapped, _marked(length), f"hash long, segment_key binary, marks {MARKS}")
    everywhere = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.length("segment") - length).cast("long").alias("last")))
    return marks.unionByName(distinct.where("repeats").select("hash", "segment_key", everywhere.cast(MARKS).alias("marks")))


def removals(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, sha (SHA-256 of the text's bytes), n_bytes, n_removed, n_spans, kept_sha256 and spans (removed byte ranges).

    A row for each row of docs. A null text is empty; texts under length bytes lose nothing; two rows with one
    text of length bytes or more lose all of it. Matches never cross texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("_text"))
    listed = materialize(rows.transform(mapped, _listed(length), "doc_id long, sha binary, n_bytes long, hashes array<long>, numbers array<int>"), "anchors")
    texts = listed.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))
    text_key = F.substring("sha", 1, 16)
    places = listed.select(text_key.alias("text_key"), F.explode(F.arrays_zip("numbers", "hashes")).alias("_p"))
    places = places.select("text_key", F.col("_p.numbers").alias("number"), F.col("_p.hashes").alias("hash"))
    places = places.repartition("hash").sortWithinPartitions("hash")
    again = places.transform(mapped, _repeated, "text_key binary, number int")
    chosen = again.groupBy("text_key").agg(F.collect_list("number").alias("numbers"))
    chosen = texts.withColumn("text_key", text_key).join(chosen, "text_key")
    chosen = chosen.select(F.col("sha").alias("_sha"), F.col("rep").alias("_rep"), "n_copies", "text_key", "numbers")
    hashed = rows.withColumn("sha", F.unhex(F.sha2("_text", 256)))
    found = hashed.join(chosen, (F.col("sha") == F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_rep")))
    pieces = found.select("_text", "sha", "n_copies", "text_key", "numbers").transform(mapped, _segments(length), PIECE)
    pieces = materialize(pieces, "segments")
    segments = pieces.where("segment IS NOT NULL")
    marks = _marks(segments, length).select(F.col("hash").alias("_hash"), F.col("segment_key").alias("_key"), "marks")
    windows = segments.select("hash", "segment_key", "text_key", "starts").join(marks, (F.col("segment_key") == F.col("_key")) & (F.col("hash") == F.col("_hash")))
    ranges = F.flatten(F.transform("starts", lambda start: F.transform("marks", lambda m: F.struct((start + m["first"]).alias("a"), (start + m["last"]).alias("b")))))
    windows = windows.groupBy("text_key").agg(F.flatten(F.collect_list(ranges)).alias("ranges"))
    windows = windows.withColumnRenamed("text_key", "_text_key")
    bodies = pieces.where("text IS NOT NULL").select("sha", "text").withColumn("_text_key", text_key)
    cleaned = bodies.join(windows, "_text_key").select("sha", "text", "ranges").transform(mapped, _cleaned(length), CLEANED)
    cleaned = cleaned.select(F.col("sha").alias("_sha"), *CLEANED_NAMES[1:])
    whole = texts.select(F.col("sha").alias("_sha2"), "n_copies")
    out = listed.select("doc_id", "sha", "n_bytes").join(whole, F.col("sha") == F.col("_sha2")).join(cleaned, F.col("sha") == F.col("_sha"), "left")
    gone = (F.col("n_copies") > 1) & (F.col("n_bytes") >= length)
    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    return out.select(
        "doc_id",
        "sha",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(gone, F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", none)).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(read(spark, sf_dir, "documents")).drop("sha", "spans")
