"""A corpus from documents to token ids: five stages, each an operator of acervo.llm over all that the last one kept.

A stage takes (spark, docs, sf_dir) and returns a table; all but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm import byte_bpe, cotraining, mixing, near_copies, substring_dedup
from acervo.llm.common import mapped, materialize, read, rows_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL can't express the classifier, the suffix arrays or the tokenizer; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject; it learns from the labels of this table's documents.

    Null and empty texts are scored like others; without labels every document stays. Repeated rows stay repeated.
    """
    model = cotraining.learn(docs, read(spark, sf_dir, "labels"))
    scored = cotraining.score(docs, model, keep=COLUMNS)
    return scored.where("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the document with the least doc_id.

    A document without doc_id stays. A doc_id may repeat: its texts that are not linked are groups of their own and
    each stays; of a group's rows with the least doc_id the one with the least digest of all its columns stays,
    however the rows are dealt out.
    """
    rows = docs.select(*COLUMNS).withColumn("digest", F.unhex(F.sha2(F.to_json(F.struct(*COLUMNS)), 256)))
    rows = rows.where("doc_id IS NOT NULL")
    found = near_copies.classes(rows, keep=("doc_id", "digest"))
    stay = found.groupBy("_root").agg(F.min(F.struct("doc_id", "digest")).alias("_least")).select("_least.*")
    named = rows.join(stay, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    return named.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text without the characters that lie wholly in a removed span of its bytes."""
    for batch in rows_of(batches):
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if spans:
                data = text.encode()
                first = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # where characters start
                starts = np.append(first, len(data))
                parts, at = [], 0
                for span in spans:
                    a = int(starts[np.searchsorted(starts, span["first"], "left")])
                    b = int(starts[np.searchsorted(starts, span["end"], "right") - 1])
                    if b > a:
                        parts.append(data[at:a])
                        at = b
                text = b"".join([*parts, data[at:]]).decode()
            texts.append(text)
        names = [n for n in batch.schema.names if n not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], [*names, "text"])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the strings of 200 bytes that start anywhere else too; n_chars follows."""
    spans = substring_dedup.removals(docs).where("n_removed > 0").select(F.col("sha").alias("_sha"), "spans").dropDuplicates(["_sha"])
    rows = docs.select(*COLUMNS).withColumn("_own", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    rows = rows.join(spans, F.col("_own") == F.col("_sha"), "left").select(*COLUMNS, "spans")
    kept = docs.select(*[c for c in COLUMNS if c != "text"]).schema.add("text", "string")
    cut = rows.transform(mapped, _cut, kept)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix starts it; the document at a source's cut stays whole.

    A null source is a source of its own; a document without words is in no mix. Equal rows are interchangeable.
    """
    mixed = mixing.mix(docs, keep=COLUMNS).where("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row, with the digests of the ids and of what they decode to.

    Null and empty texts have no ids; repeated rows stay repeated rows.
    """
    vocabulary = public_tokenizers.path(byte_bpe.VOCABULARY)
    both = byte_bpe.decode(byte_bpe.encode(docs, vocabulary), vocabulary)
    return both.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
