"""Near copies against all pairs, compared plainly."""

import random
import re

import numpy as np
import pytest

from acervo.llm import near_copies

SCHEMA = "doc_id long, text string, key string, node long"


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def plain_similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def groups_of(texts, least):
    sets, root = [plain_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if plain_similarity(sets[i], sets[j]) >= least and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    return sets, root


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(1 + rng.randrange(8)))
    out = [None, "", " \n", "a", "A", "a b", "one two three four", "One Two\tthree four"]
    for _ in range(45):
        base = [word() for _ in range(rng.choice([30, 120, 300, 900]))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            copy, rate = list(base), rng.choice([0.002, 0.01, 0.02, 0.03, 0.05])
            for i in range(len(copy)):
                if rng.random() < rate:
                    copy[i] = word()
            out.append(" ".join(copy))
    long = " ".join(word() for _ in range(40_000))
    return [*out, long, long.upper(), long + " tail", out[9]]


def test_shingles(texts):
    for t in texts[:60]:
        assert len(near_copies.shingles(t or "")) == len(plain_shingles(t))
    a, b = (near_copies.shingles(t) for t in texts[8:10])
    assert near_copies.similarity(a, b) == plain_similarity(*(plain_shingles(t) for t in texts[8:10]))


def test_fingerprint():
    found = near_copies.shingles(" ".join(f"w{i}" for i in range(700)))
    ones = [0] * near_copies.BITS
    for h in found.tolist():
        for i in range(near_copies.BITS // 64):
            mixed = near_copies._mix(np.array([(h + 0x9E3779B97F4A7C15 * (i + 1)) % 2**64], np.uint64)).tobytes()
            for k in range(64):
                ones[64 * i + k] += mixed[k // 8] >> (7 - k % 8) & 1
    assert near_copies.fingerprint(found) == np.packbits(np.array(ones) * 2 > len(found)).tobytes()
    assert near_copies.fingerprint(found[:0]) == bytes(48)


@pytest.mark.parametrize("block", [1024, 7])
def test_forest(monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = np.random.default_rng(block)
    base = rng.integers(0, 2**63, (3, 6), dtype=np.uint64)
    fps = base[rng.integers(0, 3, 40)]
    for row in fps:
        for bit in rng.integers(0, 384, rng.integers(0, 45)):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    root, weight = list(range(40)), 0
    for bits, i, j in sorted((int(far[i, j]), i, j) for i in range(40) for j in range(i) if far[i, j] <= near_copies.LOOSE):
        if root[i] != root[j]:
            weight += bits
            root = [root[j] if r == root[i] else r for r in root]
    found = near_copies.forest(fps)
    assert sum(e[2] for e in found) == weight and len(found) == 40 - len(set(root))
    assert all(far[i, j] == bits for i, j, bits in found)


@pytest.mark.parametrize("crowd", [4096, 3, 2])
def test_shared_values(monkeypatch, crowd):
    import pyarrow as pa

    monkeypatch.setattr(near_copies, "CROWD", crowd)
    far = -1
    rows = [(1, 10, True, 0), (2, 1, True, 0), (2, 5, False, 3), (2, 7, False, far), (3, 1, False, 0), (3, 2, False, 0), (4, 1, True, 0), (4, 2, True, 1), (5, 1, True, 0), (5, 2, False, far)]
    rows += [(6, n, n < 2, n % 2 - 1) for n in range(7)] + [(9, 3, True, 0)]
    least = [(2, 1), (2, 5), (4, 1), (4, 2)]
    for size in (1, 2, 3, 4, 9, 50):
        kinds = {"value": pa.int32(), "node": pa.int64(), "own": pa.bool_(), "further": pa.int64()}
        parts = (rows[i : i + size] for i in range(0, len(rows), size))
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate(kinds.values())], list(kinds)) for part in parts]
        got = sorted((r["value"], r["node"]) for b in near_copies._shared(iter(batches)) for r in b.to_pylist())
        expected = least + [(2, 7)] * (crowd == 2) + [(6, n) for n in range(7)]  # all of a crowd stay
        assert got == sorted(expected), size


@pytest.mark.parametrize("crowd", [4096, 4])
def test_classes(spark, monkeypatch, texts, crowd):
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    rows = [(i if i % 9 else None, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("at", __import__("pyspark").sql.functions.monotonically_increasing_id()).repartition(5)
    got = {r["at"]: r._root for r in near_copies.classes(docs, keep=("at", "key", "node")).collect()}
    assert len(got) == len(rows)
    order = {r["at"]: r.text for r in docs.collect()}
    ids = sorted(order)
    sets, root = groups_of([order[i] for i in ids], near_copies.SIMILARITY)
    near, met = 0, 0
    for i in range(len(ids)):
        for j in range(i):
            if plain_similarity(sets[i], sets[j]) >= near_copies.SIMILARITY:
                near += 1
                met += got[ids[i]] == got[ids[j]]
            if got[ids[i]] == got[ids[j]]:
                assert root[i] == root[j]
            if order[ids[i]] == order[ids[j]]:
                assert got[ids[i]] == got[ids[j]]
    assert near > 60 and met >= 0.95 * near


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_copies.classes(none).count() == 0
    with pytest.raises(ValueError, match="begin with _"):
        near_copies.classes(none, keep=("_key",))


def test_recall_from_similarity_0_8_to_1(spark):
    """Of the pairs in the test documents those of 0.8 and more hang together, but for one in twenty at most."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r._root for r in near_copies.classes(docs).collect()}
    sets = {r.doc_id: plain_shingles(r.text) for r in docs.collect()}
    by_shingle = {}
    for d, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in by_shingle.values() if len(ds) > 1 for i, a in enumerate(ds) for b in ds[:i]}
    near = [(a, b) for a, b in pairs if plain_similarity(sets[a], sets[b]) >= 0.8]
    assert len(near) > 50 and sum(got[a] == got[b] for a, b in near) >= 0.95 * len(near)
