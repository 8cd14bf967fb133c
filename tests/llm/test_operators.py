"""Each operator against a plain restatement, on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from acervo.llm import byte_bpe, common, components, cotraining, mixing, rule_ledger, simhash, substring_dedup, suffix_array, token_files, url_filter, winnowing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string, rank string"


def words(rng, n, vocabulary=400):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(1 + rng.randrange(9) * (i % 3 + 1) // 3)) for i in (rng.randrange(vocabulary) for _ in range(n)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [words(rng, rng.choice([1, 5, 60, 200, 400])) for _ in range(40)]
    long = words(rng, 30_000)
    texts = [None, "", " \n\t", "a", "A b\tC", *base, *base[:6], base[7] + " tail", "head " + base[7], long, long[:90_000] + "é" + long[90_000:], "É ß İ 😀 中文 it's 'S" * 30, "the same " * 300]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", "é", None]), 1, 7, "x", "y") for i, t in enumerate(texts)]
    return out + out[5:9]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def both(got, expected):
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


# --- 1 ---------------------------------------------------------------------------------------------------------
def plain_winnow(text, k, window):
    points = [ord(c) for c in text]
    if not points:
        return []
    k = min(k, len(points))
    n = len(points) - k + 1
    window = min(window, n)
    hashes = winnowing.gram_hashes(np.array(points, np.uint32), k).tolist()
    chosen = set()
    for s in range(n - window + 1):
        least = min(hashes[s : s + window])
        chosen.add(max(i for i in range(s, s + window) if hashes[i] == least))
    return [(hashes[i], i) for i in sorted(chosen)]


@pytest.mark.parametrize(("k", "window"), [(24, 27), (3, 4), (1, 1), (6, 2)])
def test_winnow(k, window, monkeypatch):
    rng = random.Random(k)
    for block in (1 << 22, 64):
        monkeypatch.setattr(winnowing, "_BLOCK", block)
        for _ in range(40):
            text = "".join(rng.choice("abé😀") for _ in range(rng.choice([0, 1, 23, 24, 50, 51, 52, 300])))
            found = winnowing.winnow(text, k, window)
            assert list(zip(found[0].tolist(), found[1].tolist(), strict=True)) == plain_winnow(text, k, window)


def test_winnow_guarantee():
    rng = random.Random(9)
    passage = words(rng, 30)[: winnowing.K + winnowing.WINDOW - 1]
    a, b = (winnowing.winnow(words(rng, 80) + passage + words(rng, 80))[0] for _ in range(2))
    assert set(a.tolist()) & set(b.tolist())


def test_against_neighbours(docs, rows, nothing):
    ordered = sorted(((d, t or "") for d, t, *_ in rows))
    expected = []
    for i, (doc, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        cut = len(text) // 4
        changed = text[: len(text) - cut] + after[:cut]
        own, new, other = (winnowing.winnow(t) for t in (text, changed, after))
        expected.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), winnowing.digest(*own), winnowing.digest(*new), winnowing.likeness(own[0], new[0]), winnowing.likeness(own[0], other[0]), len(own[0])))
    both(map(tuple, winnowing.against_neighbours(docs).collect()), expected)
    assert winnowing.against_neighbours(nothing).count() == 0
    row = winnowing.fingerprints(docs.where("doc_id = 30")).first()
    assert [(x.hash, x.position) for x in row.fingerprint] == plain_winnow(rows[30][1], winnowing.K, winnowing.WINDOW)


# --- 2 ---------------------------------------------------------------------------------------------------------
def test_byte_bpe_round_trip(docs, rows, nothing, monkeypatch):
    import tiktoken

    monkeypatch.setattr(byte_bpe, "CHUNK_WORDS", 500)
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.decode(byte_bpe.encode(docs, path), path).collect()
    expected = [(d, np.array(plain.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t, *_ in rows]
    both([(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got], expected)
    assert byte_bpe.digests(nothing, path).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------------------
def taught_rows():
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.7
        text = words(rng, 80)
        if not good:
            text = text.upper() if i % 2 else " ".join(w + rng.choice(["###", "$$$"]) for w in text.split())
        rows.append((i, text, "en", "s1" if good == (rng.random() < 0.8) else "s2", len(text), 1, "x", "y"))
        if i < 500:
            labels.append((i, int(good), None if i % 50 else 1))
    return rows, labels


def test_cotraining_held_out(spark, nothing):
    rows, labels = taught_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, other int")
    model = cotraining.learn(docs, known)
    found = {r.doc_id: r.kept for r in cotraining.score(docs, model).collect()}
    truth = {r[0]: r[1].islower() and "#" not in r[1] and "$" not in r[1] for r in rows}
    assert np.mean([found[i] == truth[i] for i in range(500, 900)]) > 0.97
    again = cotraining.learn(docs.repartition(3), known)
    assert {r.doc_id: r.kept for r in cotraining.score(docs, again).collect()} == found
    assert cotraining.score(nothing, model).count() == 0


def plain_line(z, y, ridge):
    """Platt's line, row by row."""
    z = np.column_stack([z, np.ones(len(z))])
    aim = np.where(y > 0, (sum(y > 0) + 1) / (sum(y > 0) + 2), 1 / (sum(y < 0) + 2))
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.clip(np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge * np.eye(len(w)), z.T @ (aim - p) - ridge * w), -2, 2)
    return w


def plain_model(z, y, weight):
    mean, level = np.average(z, axis=0, weights=weight), np.average(y, weights=weight)
    scale = np.sqrt(np.average((z - mean) ** 2, axis=0, weights=weight)) + 0.01
    unit, share = (z - mean) / scale, weight / weight.sum()
    w = np.linalg.solve((unit.T * share) @ unit + cotraining.RIDGE * np.eye(z.shape[1]), unit.T @ (share * (y - level)))
    return lambda rows: np.clip((rows - mean) / scale @ w + level, -cotraining.REACH, cotraining.REACH)


def plain_cotraining(x, m, y, held):
    """The rounds over whole matrices: y is 1, -1 or 0 (no label)."""
    taught, spare = (y != 0) & ~held, y == 0
    views, lessons = (x, m), [(taught, y.astype(float), np.ones(len(y)))] * 2
    for number in range(cotraining.ROUNDS + 1):
        models = [plain_model(v[on], t[on], w[on]) for v, (on, t, w) in zip(views, lessons, strict=True)]
        lines = [plain_line(f(v[held])[:, None], y[held], 1e-3) for v, f in zip(views, models, strict=True)]
        logits = [line[0] * f(v) + line[1] for v, f, line in zip(views, models, lines, strict=True)]
        if number == cotraining.ROUNDS:
            break
        lessons = []
        for other in (logits[1], logits[0]):
            p = 1 / (1 + np.exp(-other))
            given = spare & (np.maximum(p, 1 - p) >= cotraining.SURE)
            weight = np.where(given, min(1, taught.sum() / max(given.sum(), 1)), 1.0)
            lessons.append((taught | given, np.where(given, np.where(p > 0.5, 1.0, -1.0), y), weight))
    both = plain_line(np.column_stack(logits)[held], y[held], 1e-2)
    return 1 / (1 + np.exp(-(both[0] * logits[0] + both[1] * logits[1] + both[2])))


def test_cotraining_plainly(spark):
    rows, labels = taught_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, other int")
    found = {r.doc_id: r.score for r in cotraining.score(docs, cotraining.learn(docs, known)).collect()}
    fold = {r[0]: r[1] for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {cotraining.FOLDS})").collect()}
    label = {d: 2 * q - 1 for d, q, _ in labels}
    x = np.array([cotraining.text_view(r[1]) for r in rows], float)
    m = np.array([cotraining.meta_view(("source", "lang", "n_chars"), (r[3], r[2], r[4])) for r in rows], float)
    y = np.array([label.get(r[0], 0) for r in rows])
    expected = plain_cotraining(x, m, y, np.array([fold[r[0]] == 0 for r in rows]) & (y != 0))
    got = np.array([found[r[0]] for r in rows])
    assert np.abs(got - expected).max() < 0.02  # the histogram's steps


def test_text_view():
    text = "ab ab\nab ab"
    view = cotraining.text_view(text)
    assert view[ord("a")] == round(255 * (4 / 11) ** 0.5) and view[-4:].tolist() == [round(255 * 3 / 4), round(255 * 3 / 4), round(255 * 11 / 4 / 50), round(255 / 2)]
    grams = np.zeros(256)
    for i in range(8):
        grams[int.from_bytes(text.encode()[i : i + 4], "little") * 2654435761 % 2**32 >> 24] += 1
    assert view[256:512].tolist() == np.rint(255 * np.sqrt(grams / 8)).tolist() and not cotraining.text_view("").any()


def test_cotraining_without_lessons(spark, docs, nothing):
    none = spark.createDataFrame([(2, None), (999, 0)], "doc_id long, quality int")
    rows = cotraining.score(docs, cotraining.learn(docs, none)).collect()
    assert len(rows) == docs.count() and all(r.kept and r.score == 0.5 for r in rows)
    assert cotraining.score(nothing, cotraining.learn(nothing, none)).count() == 0
    one = spark.createDataFrame([(1, 1), (1, 0), (3, 1)], "doc_id long, quality int")
    assert cotraining.score(docs, cotraining.learn(docs, one)).count() == docs.count()


def test_cotraining_with_clashing_columns(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    table = docs.withColumns({"score": docs.size, "x": docs.size})
    found = cotraining.score(table, cotraining.learn(table, none), keep=("doc_id", "score", "x", "text"))
    assert found.columns == ["doc_id", "x", "text", "text_score", "meta_score", "score", "kept"] and found.first().score == 0.5
    with pytest.raises(ValueError, match="begin with _"):
        cotraining.score(table, cotraining.learn(table, none), keep=("_id",))


# --- 5 ---------------------------------------------------------------------------------------------------------
def plain_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(w) < 2000 else None
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), covered and len(covered) or 0


def test_rule_ledger(spark, docs, rows, nothing):
    extra = [(900 + i, t, None, None, 1, 1, "", "") for i, t in enumerate(["a b c a b c d", "x\nx\n \nx", "#|<>", "a a a a a", "one two three one two three " * 9])]
    table = spark.createDataFrame([*rows, *extra], SCHEMA)
    got = rule_ledger.apply_policy(rule_ledger.ledger(table)).collect()
    texts = {r[0]: r[1] or "" for r in [*rows, *extra]}
    assert len(got) == len(rows) + len(extra)
    for r in got:
        expected = plain_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == expected[:4]
        if r.n_words < 2000:
            assert r.n_repeat_words == expected[4]
        assert r.kept == (r.failed & rule_ledger.mask(rule_ledger.CURRENT) == 0)
    assert rule_ledger.ledger(nothing).count() == 0
    rules = {r.rule: r for r in rule_ledger.ablations(rule_ledger.ledger(table)).collect()}
    bits = [r.failed for r in got]
    for name, bit in rule_ledger.RULES.items():
        rest = rule_ledger.mask(rule_ledger.CURRENT) & ~(1 << bit)
        assert rules[name].n_failed == sum(b >> bit & 1 for b in bits)
        assert rules[name].n_only == sum(b == 1 << bit for b in bits)
        assert rules[name].n_kept_without == sum(b & rest == 0 for b in bits)


# --- 6 ---------------------------------------------------------------------------------------------------------
def test_suffix_array(monkeypatch):
    rng = random.Random(0)
    for small in (1024, 2):
        monkeypatch.setattr(suffix_array, "SMALL", small)
        for _ in range(400):
            text = [rng.randrange(rng.choice([1, 2, 5, 30])) for _ in range(rng.randrange(50))] * rng.choice([1, 1, 3])
            order = suffix_array.suffix_array(np.array(text, np.int64))
            assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
            expected = [0] * len(text)
            for a, b in zip(order, order[1:]):  # noqa: B905
                while expected[b] < len(text) - max(a, b) and text[a + expected[b]] == text[b + expected[b]]:
                    expected[b] += 1
            assert suffix_array.permuted_prefixes(np.array(text), order).tolist() == expected


def plain_removed(texts, length):
    seen = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], []).append((i, s))
    gone = [np.zeros(len(t), bool) for t in texts]
    for at in seen.values():
        if len(at) > 1:
            for i, s in at:
                gone[i][s : s + length] = True
    return gone


@pytest.mark.parametrize("crowd", [256, 1])
def test_substring_dedup(spark, nothing, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    rng = random.Random(7)
    passage, other = words(rng, 60), "ab" * 150
    texts = [None, "", "short", passage, passage, other, *(words(rng, 50) + passage[i : i + 260] + words(rng, 30) for i in (0, 3, 50)), "é" * 99 + "x", "é" * 150, words(rng, 300)]
    texts += [texts[6] + "é", texts[7][:100] + "!" + texts[7][100:], passage[:220] + passage[:220]]
    rows = [(i if i != 4 else None, t, None, None, 1, 1, "a", "b") for i, t in enumerate(texts)]
    rows.append(rows[-1])
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    data = [(t or "").encode() for _, t, *_ in rows]
    expected = []
    for (doc, *_), t, gone in zip(rows, data, plain_removed(data, substring_dedup.LENGTH), strict=True):
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        expected.append((doc, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    got = substring_dedup.removals(table)
    both(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), expected)
    assert sum(e[2] for e in expected) > 1500
    assert substring_dedup.removals(nothing).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------------------
def test_mixing(docs, rows, nothing):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = {}
    for _, t, _, source, *_ in rows:
        by_source[source] = by_source.get(source, 0) + size(t)
    names = sorted((s for s in by_source if s is not None)) + [None] * (None in by_source)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(by_source.values()), set()
    while True:
        level = (total - sum(2 * by_source[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and level * weight[s] > 2 * by_source[s]}
        if not over:
            break
        full |= over
    taken = {}
    for r in got:
        target = 2 * by_source[r.source] if r.source in full else level * weight[r.source]
        assert r.target == pytest.approx(target) and r.source_size == by_source[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = (taken.get(r.source, (0, 0))[0] + r.taken, target)
    assert all(int(t) == n for n, t in taken.values())
    both(map(tuple, mixing.mix(docs.repartition(2)).collect()), map(tuple, got))
    assert mixing.mix(nothing).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------------
def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows, distance=3):
    ids = list(range(len(rows)))
    group = {i: i for i in ids}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in ids:
        for j in ids[:i]:
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
                group[root(i)] = root(j)
    least = {}
    for i in ids:
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return [(rows[i][0], f"{rows[i][1]:016x}", least.get(root(i))) for i in ids]


def test_simhash(docs, rows, nothing):
    got = simhash.classes(simhash.fingerprints(docs)).collect()
    both([(r.doc_id, f"{r._fp & 2**64 - 1:016x}", r.component_id) for r in got], plain_classes([(d, plain_fingerprint(t or "")) for d, t, *_ in rows]))
    assert simhash.classes(simhash.fingerprints(nothing)).count() == 0


@pytest.mark.parametrize("split", [20_000, 3])
def test_simhash_links(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = random.Random(split)
    values = []
    for _ in range(25):
        v = rng.getrandbits(64)
        values.append(v)
        for _ in range(rng.randrange(8)):
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                v ^= 1 << rng.randrange(64)
            values.append(v)
    rows = [(None if i % 17 == 3 else i, v) for i, v in enumerate(values)]
    table = spark.createDataFrame([(d, v - (1 << 64) if v >> 63 else v) for d, v in rows], "doc_id long, _fp long")
    got = [(r.doc_id, f"{r._fp & 2**64 - 1:016x}", r.component_id) for r in simhash.classes(table).collect()]
    both(got, plain_classes(rows))


def test_simhash_forest_of_a_crowd():
    """A large group of near values hangs together as all its links would have it."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 30, (5000, 3), dtype=np.uint64)) * (rng.random((5000, 3)) < 0.6)
    values = np.unique(base[rng.integers(0, 3, 5000)] ^ np.bitwise_xor.reduce(flips.astype(np.uint64), axis=1))
    a, b = simhash.forest(values, np.ones(len(values), bool))
    found = simhash._Forest(len(values))
    found.join(a, b)
    exact = simhash._Forest(len(values))
    for start in range(0, len(values), 500):
        i, j = np.nonzero(np.bitwise_count(values[start : start + 500][:, None] ^ values[None, :]) <= 3)
        exact.join(i + start, j)
    pairs = lambda f: len(np.unique(f.roots()))
    assert pairs(found) == pairs(exact) and len(np.unique(np.stack([found.roots(), exact.roots()]), axis=1)[0]) == pairs(exact)


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(30)] + [(200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    group = {x: x for pair in links for x in pair}
    for _ in range(200):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    assert got == {k: v for k, v in group.items() if k != 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 9 ---------------------------------------------------------------------------------------------------------
def test_value_code():
    rng = np.random.default_rng(0)
    for values in ([], [0], [255, 256, 65535, 65536, 2**24, 2**32 - 1, 5], rng.zipf(1.3, 10_001) % 2**32):
        lengths, ranks = token_files.unpack(token_files.pack(np.array([len(values)]), np.array(values, np.uint32)))
        assert ranks.tolist() == list(values) and lengths.tolist() == [len(values)]
    with pytest.raises(ValueError, match="not a block"):
        token_files.unpack(bytes(40))


def test_token_files(spark, docs, rows, nothing, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "BLOCK_IDS", 3000)
    vocabulary = public_tokenizers.path(token_files.VOCABULARY)
    plain = Tokenizer.from_file(vocabulary)
    path = common.new_path(spark, "tokens")
    token_files.write(docs, path, vocabulary)
    got = sorted(map(tuple, token_files.scan(spark, path).collect()), key=lambda r: r[1])
    coded = sorted((d, [*plain.encode(t or "", add_special_tokens=False).ids, 1]) for d, t, *_ in rows)
    start, expected = 0, []
    for doc, ids in coded:
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    empty = common.new_path(spark, "tokens")
    token_files.write(nothing, empty, vocabulary)
    assert token_files.scan(spark, empty).count() == 0


def test_pieces_are_the_tokenizers():
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path(token_files.VOCABULARY)
    plain = Tokenizer.from_file(vocabulary)
    rng = random.Random(5)
    signs = ["a", "B", "é", "'s", "'", "S", "t", "re", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "1", "23", "²", "ª", "µ", "ß", "!", "<|endoftext|>", "<|", "|>", "İ", "Σ", "\u0301", "中", "😀", "ﬁ", "\x00", "Ÿ", "×"]
    texts = ["мир \xa0 я- слово", "ABC 中 Él-É я", "a' 's 't''s x"]
    for _ in range(2000):
        text = "".join(rng.choice(signs[: rng.choice([16, len(signs)])]) for _ in range(rng.randrange(12)))
        texts.append(text)
        assert np.frombuffer(token_files.encode_texts([text], vocabulary)[0], "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    token_files._coder(vocabulary)[3].clear()  # all at once, nothing known
    for text, ids in zip(texts, token_files.encode_texts(texts, vocabulary), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


# --- 10 --------------------------------------------------------------------------------------------------------
def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]+", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, url_filter.DEFAULT))
    return host, path, rule, verdict


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://org", "HTTP://A.ORG/x", "http://example.org/es/", "http://www.Example.ORG/en/123?q#f", "http://example.org/en/2", "x://notexample.org/es/1", "http://a.com/fr/", "http://a.com/de", "http://com/de/x", "http://a.com?x=/de/", "a://b://c.org/é", "http://é.org/" + "p" * 5000, "http://u@a.org:80/", "http://a\n.org/x"]
    rows = [(i, u, "clash", "h") for i, u in enumerate(urls)] * 2
    table = spark.createDataFrame(rows, "page_id long, url string, rule string, host string")
    rules = spark.createDataFrame(url_filter.RULES + url_filter.RULES[:1], "host string, path string, verdict string")
    got = url_filter.judge(table, rules).select("page_id", "host", "path", "rule", "verdict").collect()
    both(map(tuple, got), [(i, *plain_verdict(u)) for i, u, *_ in rows])
    assert url_filter.judge(table.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(table, rules.limit(0)).collect()} == {url_filter.DEFAULT}


# --- names ------------------------------------------------------------------------------------------------------
def test_kept_columns_that_clash(spark):
    """A kept column with a result's name gives way to the result; a kept name that begins with _ is an error."""
    table = spark.createDataFrame([(1, "a b c", "s", 9, 9, 9, 9)], "doc_id long, text string, source string, size long, failed long, fingerprint long, component_id long")
    assert mixing.mix(table, keep=("size", "text")).select("size").first()[0] == 3
    assert rule_ledger.ledger(table, keep=("doc_id", "failed", "size")).columns[:2] == ["doc_id", "size"]
    assert winnowing.fingerprints(table, keep=("doc_id", "fingerprint")).columns == ["doc_id", "fingerprint"]
    rows = simhash.classes(simhash.fingerprints(table.withColumn("fp", table.size), keep=("doc_id", "component_id", "fp")))
    assert rows.first().component_id == 1 and rows.first().fp == 9
    for operator in (winnowing.fingerprints, rule_ledger.ledger, simhash.fingerprints, mixing.mix):
        with pytest.raises(ValueError, match="begin with _"):
            operator(table, keep=("_text",))


def test_sizes_of_settings():
    assert [common.setting_bytes(x) for x in ("64", "64m", "8MB", "1g", "-1")] == [64, 64 << 20, 8 << 20, 1 << 30, 1 << 62]
