"""A quality classifier by co-training.

Two views of a document, its text and its metadata, have a linear model each (regularized least squares on the
labels as +1 and -1). A model needs only sums over its lessons: the products of its columns with each other and
with the label. So every labelled row and, in every round, every document without a label that the other view is
sure of takes part; each task adds up its own rows, and one matrix reaches the driver. A third of the labelled
documents, from which neither view learns, calibrates both and weighs them against each other, as a histogram of
their two scores. In the end every document is scored.

Columns are whole numbers, so the sums are exact and do not depend on the order of rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm.common import kept, mapped, materialize, read, rows_of, whole_text

ROUNDS = 2
#: A pseudo-label needs this probability, after calibration.
SURE = 0.98
#: Documents below this score are rejected.
THRESHOLD = 0.5
#: Of so many parts of the labelled ids one is held out.
FOLDS = 3
#: Added to each standardized column's variance.
RIDGE = 0.1

METADATA = ("source", "lang", "n_chars")
GRAM_BINS = 256
TEXT_DIMS = 256 + GRAM_BINS + 4
META_DIMS = 256
#: Calibration sees scores from -REACH to REACH in so many steps.
REACH, STEPS = 4.0, 256
#: Rows of a matrix product at a time.
PART = 4096
RESULTS = ("text_score", "meta_score", "score", "kept")


# --- views -----------------------------------------------------------------------------------------------------
def text_view(text: str) -> np.ndarray:
    """Roots of the shares of bytes and of hashed 4-byte grams, and how words and lines repeat, as numbers from 0 to 255."""
    out = np.zeros(TEXT_DIMS, np.float64)
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return out.astype(np.uint8)
    out[:256] = np.sqrt(np.bincount(data, minlength=256) / len(data))
    bins = np.zeros(GRAM_BINS, np.int64)
    for start in range(0, max(len(data) - 3, 0), 1 << 20):
        d = data[start : start + (1 << 20) + 3].astype(np.uint32)
        gram = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)
        bins += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(24), minlength=GRAM_BINS)
    out[256 : 256 + GRAM_BINS] = np.sqrt(bins / max(bins.sum(), 1))
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    if words:
        out[-4] = sum(map(str.__eq__, words, words[1:])) / len(words)
        out[-3] = 1 - len(set(words)) / len(words)
        out[-2] = min(len(text) / len(words), 50) / 50
        out[-1] = 1 - len(set(lines)) / len(lines) if lines else 0
    return np.rint(out * 255).astype(np.uint8)


def _bin(name: str, value: str) -> int:
    return zlib.crc32(f"{name}={value}".encode()) % META_DIMS


def meta_view(names: tuple[str, ...], values: tuple) -> np.ndarray:
    """A bin for each column's value; numbers by their power of two."""
    out = np.zeros(META_DIMS, np.uint8)
    for name, value in zip(names, values, strict=True):
        shown = "?" if value is None else f"2^{int(abs(value)).bit_length()}" if isinstance(value, (int, float)) else str(value)
        out[_bin(name, shown)] = 1
    return out


# --- models from sums ------------------------------------------------------------------------------------------
def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Model:
    """A linear score, and its calibration (slope and shift of its logit)."""

    weights: np.ndarray
    bias: float
    slope: float = 0.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * np.clip(self.raw(x), -REACH, REACH) + self.shift


def sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of the columns (a 1 and the label, +1 or -1, behind them) with each other: all that fit needs."""
    z = np.column_stack([x.astype(np.float64), np.ones(len(x)), y])
    return z.T @ z


def fit(total: np.ndarray, ridge: float = RIDGE) -> Model:
    """The least-squares model of standardized columns; without lessons it scores nothing."""
    n, size = total[-2, -2], len(total) - 2
    if not n:
        return Model(np.zeros(size), 0.0)
    mean, level = total[-2, :size] / n, total[-1, -2] / n
    spread = total[:size, :size] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(spread), 0)) + 0.01
    aim = (total[-1, :size] / n - mean * level) / scale
    weights = np.linalg.solve(spread / np.outer(scale, scale) + ridge * np.eye(size), aim) / scale
    return Model(weights, float(level - mean @ weights))


def fit_line(x: np.ndarray, n_good: np.ndarray, n_bad: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Platt's line for rows of a few columns, each with its counts; weights and, last, the intercept."""
    z = np.column_stack([x, np.ones(len(x))])
    good, bad = n_good.sum(), n_bad.sum()
    n, hits = n_good + n_bad, n_good * (good + 1) / (good + 2) + n_bad / (bad + 2)
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (hits - n * p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Classifier:
    text: Model
    meta: Model
    weights: np.ndarray  # of the calibrated logits of text and metadata, and the intercept
    history: list = field(default_factory=list)  # pseudo-labels of each round: given to text, given to metadata

    def score(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(x), self.meta.logit(m)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.weights[0] * a + self.weights[1] * b + self.weights[2])


def histogram(text: Model, meta: Model, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows by class and step of both scores."""
    at = [np.clip(((v + REACH) / (2 * REACH) * STEPS).astype(np.int64), 0, STEPS - 1) for v in (text.raw(x), meta.raw(m))]
    cell = ((y > 0) * STEPS + at[0]) * STEPS + at[1]
    return np.bincount(cell, minlength=2 * STEPS * STEPS).reshape(2, STEPS, STEPS)


def calibrate(text: Model, meta: Model, seen: np.ndarray) -> np.ndarray:
    """Gives both models their calibration from a histogram; returns the weights of their logits."""
    centre = (np.arange(STEPS) + 0.5) / STEPS * 2 * REACH - REACH
    for model, axis in ((text, 2), (meta, 1)):
        bad, good = seen.sum(axis=axis)
        model.slope, model.shift = map(float, fit_line(centre[:, None], good, bad))
    i, j = np.nonzero(seen.sum(axis=0))
    logits = np.column_stack([text.slope * centre[i] + text.shift, meta.slope * centre[j] + meta.shift])
    return fit_line(logits, seen[1, i, j], seen[0, i, j], ridge=1e-2)


def sure_labels(model: Model, x: np.ndarray, sure: float = SURE) -> np.ndarray:
    """+1, -1, or 0 where the calibrated probability is not sure."""
    p = _sigmoid(model.logit(x))
    return np.where(p >= sure, 1, np.where(p <= 1 - sure, -1, 0))


def mixed(lessons: np.ndarray, pseudo: np.ndarray) -> np.ndarray:
    """Lessons and pseudo-labels together, the latter weighing as much as the former at most."""
    own, other = lessons[-2, -2], pseudo[-2, -2]
    return lessons + pseudo * min(1.0, own / other) if other else lessons


def cotrain(gather, held, rounds: int = ROUNDS) -> Classifier:
    """The rounds. gather(models or None) gives the sums of text's and metadata's lessons: the labelled ones, or those
    that the models' sure labels make; held(models) the histogram of the rows that are held out."""
    lessons, history = gather(None), []
    views = [fit(x) for x in lessons]
    weights = calibrate(*views, held(views))
    for _ in range(rounds):
        pseudo = gather(views)
        history.append(tuple(int(x[-2, -2]) for x in pseudo))
        if not any(history[-1]):
            break
        views = [fit(mixed(*both)) for both in zip(lessons, pseudo, strict=True)]
        weights = calibrate(*views, held(views))
    return Classifier(*views, weights, history)


# --- over tables -----------------------------------------------------------------------------------------------
def _views(names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            x = [text_view(t).tobytes() for t in batch.column("_text").to_pylist()]
            meta = zip(*(batch.column(f"_meta_{n}").to_pylist() for n in names), strict=True) if names else [()] * batch.num_rows
            m = [meta_view(names, v).tobytes() for v in meta]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(x, pa.binary()), pa.array(m, pa.binary())], ["_id", "x", "m"])

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _parts(batches: Iterator[pa.RecordBatch], label: str | None):
    """Text columns, metadata columns and labels (+1, -1), some rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, PART):
            part = batch.slice(start, PART)
            y = np.array(part.column(label).to_pylist(), float) if label else np.zeros(part.num_rows)
            yield _matrix(part.column("x"), TEXT_DIMS), _matrix(part.column("m"), META_DIMS), np.where(y > 0.5, 1.0, -1.0)


def _packed(*arrays: np.ndarray) -> pa.RecordBatch:
    body = zstandard.compress(b"".join(a.astype(np.float64).tobytes() for a in arrays), 1)
    return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["body"])


def _numbers(body: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(body), np.float64)


_TRIANGLES = {n: np.triu_indices(n) for n in (TEXT_DIMS + 2, META_DIMS + 2)}


def _whole(upper: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[_TRIANGLES[size]] = upper
    return out + np.triu(out, 1).T


def _lessons(shared):
    """A task's sums for both views, as upper triangles in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value if shared else None
        text, meta = np.zeros((TEXT_DIMS + 2,) * 2), np.zeros((META_DIMS + 2,) * 2)
        for x, m, y in _parts(batches, None if models else "_label"):
            for_text, for_meta = (sure_labels(models[1], m), sure_labels(models[0], x)) if models else (y, y)
            text += sums(x[for_text != 0], for_text[for_text != 0])
            meta += sums(m[for_meta != 0], for_meta[for_meta != 0])
        yield _packed(*(a[_TRIANGLES[len(a)]] for a in (text, meta)))

    return run


def _histograms(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, meta = shared.value
        seen = np.zeros((2, STEPS, STEPS), np.int64)
        for x, m, y in _parts(batches, "_label"):
            seen += histogram(text, meta, x, m, y)
        yield _packed(seen)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for body in batch.column("body").to_pylist():
            total = _numbers(body) + (0 if total is None else total)
    if total is not None:
        yield _packed(total)


def _total(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' rows, added up in two steps; one row reaches the driver."""
    some = rows.repartition(8).transform(mapped, _added, "body binary")
    return _numbers(some.repartition(1).transform(mapped, _added, "body binary").first()[0])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", metadata: tuple[str, ...] = METADATA, rounds: int = ROUNDS) -> Classifier:
    """A classifier from docs and labels (doc_id and the label column, 1 for good).

    Every labelled row teaches or, where its id's hash says so, is held out; every row without a label may get a
    pseudo-label. Labels of no document and null labels count for nothing; of a document's several labels the
    least holds; repeated rows of docs count each. Where nothing is labelled, every document gets the score 0.5,
    which keeps it. Null texts are empty; metadata may be null or absent.
    """
    spark = docs.sparkSession
    metadata = tuple(c for c in metadata if c in docs.columns)
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_label")).where("_id IS NOT NULL AND _label IS NOT NULL")
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"))
    rows = docs.select(F.col("doc_id").alias("_id"), whole_text(text).alias("_text"), *[F.col(c).alias(f"_meta_{c}") for c in metadata])
    kind = docs.schema["doc_id"].dataType.simpleString()
    views = rows.transform(mapped, _views(metadata), f"_id {kind}, x binary, m binary").join(known, "_id", "left")
    held = F.when(F.col("_label").isNull(), -1).otherwise((F.pmod(F.xxhash64("_id"), F.lit(FOLDS)) == 0).cast("int"))
    views = materialize(views.select("_label", held.alias("_part"), "x", "m"), "views")
    taught, spare, apart = (views.where(F.col("_part") == part) for part in (0, -1, 1))

    def gather(models) -> list[np.ndarray]:
        if models:
            rows, shared = spare.select("x", "m"), spark.sparkContext.broadcast(models)  # some hundred numbers
        else:
            rows, shared = taught.select("_label", "x", "m"), None
        flat = _total(rows.transform(mapped, _lessons(shared), "body binary"))
        cut = len(_TRIANGLES[TEXT_DIMS + 2][0])
        return [_whole(flat[:cut], TEXT_DIMS + 2), _whole(flat[cut:], META_DIMS + 2)]

    def seen(models) -> np.ndarray:
        shared = spark.sparkContext.broadcast(models)
        flat = _total(apart.select("_label", "x", "m").transform(mapped, _histograms(shared), "body binary"))
        return flat.reshape(2, STEPS, STEPS)

    return cotrain(gather, seen, rounds)


def _scored(shared, names: tuple[str, ...], keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in rows_of(batches, 4 << 20):
            found: list[list[np.ndarray]] = [[], [], []]
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                x = np.stack([text_view(t) for t in part.column("_text").to_pylist()])
                meta = zip(*(part.column(f"_meta_{n}").to_pylist() for n in names), strict=True) if names else [()] * part.num_rows
                m = np.stack([meta_view(names, v) for v in meta])
                for column, values in zip(found, model.score(x, m), strict=True):
                    column.append(values)
            columns = [batch.column(i) for i in range(keep)] + [pa.array(np.concatenate(c)) for c in found]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:keep], "text_score", "meta_score", "score"])

    return run


def score(docs: DataFrame, model: Classifier, keep: tuple[str, ...] = ("doc_id",), text: str = "text", metadata: tuple[str, ...] = METADATA, threshold: float = THRESHOLD) -> DataFrame:
    """keep's columns with text_score, meta_score, score (probabilities of quality) and kept, for every row of docs.

    Clashing names follow common.kept. An empty table gives no rows, a null text counts as empty.
    """
    keep = kept(keep, RESULTS)
    metadata = tuple(c for c in metadata if c in docs.columns)
    schema = docs.select(*keep).schema
    for name in ("text_score", "meta_score", "score"):
        schema = schema.add(name, "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred numbers
    rows = docs.select(*keep, whole_text(text).alias("_text"), *[F.col(c).alias(f"_meta_{c}") for c in metadata])
    return rows.transform(mapped, _scored(shared, metadata, len(keep)), schema).withColumn("kept", F.col("score") >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, learn(docs, read(spark, sf_dir, "labels")))
