"""The pipeline's stages and its result against plain versions of the operators."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from acervo.llm import cotraining, mixing
from test_near_copies import groups_of, plain_shingles, plain_similarity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF)
        out.append(result.toPandas())
        docs = spark.createDataFrame(out[-1], result.schema)
    return out


def test_quality(spark, stages):
    before, after = stages[0], stages[1]
    docs = spark.createDataFrame(before)
    model = cotraining.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in cotraining.score(docs, model).where("kept").collect()}
    assert set(after.doc_id) == kept and 0 < len(after) < len(before)
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    good = set(labels[labels.quality == 1].doc_id)
    assert len(good & set(after.doc_id)) >= 0.95 * len(good)


def test_one_of_each_group(stages):
    before, after = stages[1], stages[2]
    texts = before.text.fillna("").tolist()
    _, root = groups_of(texts, 0.8)
    least = {}
    for d, r in zip(before.doc_id, root, strict=True):
        least[r] = min(d, least.get(r, d))
    assert set(after.doc_id) == set(least.values())
    assert list(after.columns) == list(corpus_pipeline.COLUMNS)


def test_passages(stages):
    before, after = stages[2], stages[3]
    data = {d: t.encode() for d, t in zip(before.doc_id, before.text, strict=True)}
    seen = {}
    for d, t in data.items():
        for s in range(len(t) - 199):
            seen.setdefault(t[s : s + 200], []).append((d, s))
    gone = {d: np.zeros(len(t), bool) for d, t in data.items()}
    for at in seen.values():
        for d, s in at if len(at) > 1 else []:
            gone[d][s : s + 200] = True
    for d, t, n in zip(after.doc_id, after.text, after.n_chars, strict=True):
        whole = [c for c, at in zip(before.set_index("doc_id").text[d], _places(data[d]), strict=True) if not gone[d][at[0] : at[1]].all()]
        assert t == "".join(whole) and n == len(t)
    assert len(after) == len(before)


def _places(data: bytes) -> list[tuple[int, int]]:
    starts = [i for i, b in enumerate(data) if b & 0xC0 != 0x80]
    return list(zip(starts, [*starts[1:], len(data)], strict=True))


def test_mix(spark, stages):
    before, after = stages[3], stages[4]
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(before)).collect()}
    assert after.doc_id.value_counts().to_dict() == {d: n for d, n in copies.items() if n}


def test_tokens(stages):
    before, after = stages[4], stages[5]
    assert len(after) == len(before)
    digest = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in zip(before.doc_id, before.text, strict=True)}
    assert all(digest[d] == x for d, x in zip(after.doc_id, after.decoded_sha256, strict=True))


def test_nulls_and_nothing(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (None, "a b", None, "s", 3), (1, "", "en", None, 0), (2, None, "en", "s", None), (2, "x y z" * 99, "en", "s", 5), (2, "x y z" * 99, "en", "s", 5)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, SF)
            docs = spark.createDataFrame(result.collect(), result.schema)
        docs.count()


def test_repeated_ids(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    one, two, three = (" ".join(f"{w}{i * i}" for i in range(80)) for w in ("a", "b", "c"))
    rows = [(2, one, "en", "s", 5), (2, two, "en", "s", 5), (2, one, "en", "s", 5), (2, two, "de", "t", 5), (3, one, "en", "s", 5), (3, three, "en", "s", 5), (4, three, "en", "s", 5)]
    sets = [plain_shingles(t) for t in (one, two, three)]
    assert all(plain_similarity(a, b) < 0.5 for a in sets for b in sets if a is not b)
    results = set()
    for parts in (1, 3, 7):
        for dealt in (rows, rows[::-1]):
            kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(dealt, schema).repartition(parts), SF).collect()
            assert sorted((r.doc_id, r.text) for r in kept) == sorted([(2, one), (2, two), (3, three)])
            results.add(tuple(sorted(map(tuple, kept))))
    assert len(results) == 1
