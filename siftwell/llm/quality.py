"""Operator 10: quality classifier on random-indexing word vectors.

Every word has a fixed sparse random index vector; its word vector is the sum of its neighbours' index vectors over the
training texts, weighted to unit length. Words outside the kept vocabulary share the vector of their shape (case, digit
or symbol pattern), which is learned alike. A document pools its word vectors (mean and mean square) together with the
mean similarity of index vectors one and two words apart, which shows repetition, and its length. A two-layer network in
numpy gives the score; its temperature is fitted on a part of the training rows that the weights haven't seen.

The model is fitted on a sample of labelled documents of at most about MAX_TRAIN (chosen by hash; one text of each id). Its
texts stay on the executors: tasks count words, then sum index vectors, then pool features, and Spark adds up what tasks
found. The driver gets the MAX_VOCABULARY most frequent words of at least MIN_COUNT occurrences, MAX_SHAPES shapes, their
vectors, and FEATURES numbers for each document of the sample, whatever the lengths of texts. Whole texts are read, in
training and in scoring. Sums are of whole numbers, so that they don't depend on how rows are dealt.

Defined results: null, empty and wordless texts get the score of a document without words; a null label is not learned
from; without labelled rows of both classes, the score is the share of label 1 (0.5 without any); a null doc_id counts
as not held out; an id with several labels has the greatest, with several texts the least; repeated rows get equal
scores; other columns are ignored, and a carried column that is called ``score`` gives way to the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ship, table
from .language_id import bounded_sample, held_out
from .token_output import slices

MAX_TRAIN = 3_000
MAX_VOCABULARY, MIN_COUNT, MAX_SHAPES = 20_000, 3, 2_000
DIM, NONZERO, WINDOW = 48, 4, 2
FEATURES = 2 * DIM + 3
HIDDEN, EPOCHS, RATE = 24, 300, 0.01
THRESHOLD = 0.3
KEPT = 200_000
#: Tasks that fit; words that a task holds at once when it counts them or sums their neighbours.
FIT_TASKS, AT_ONCE = 6, 100_000
_TOKENS = re.compile(r"\w+|[^\w\s]+")
_caches: dict[object, tuple] = {}


def shape(word: str) -> str:
    """A word's class: case of letters, digits, or its symbols."""
    if not (word[0].isalnum() or word[0] == "_"):
        return "~" + word[:3]
    if word.isdigit():
        return "~9"
    if word.isupper() and len(word) > 1:
        return "~XX"
    if word[0].isupper() and (len(word) == 1 or word[1:].islower()):
        return "~Xx"
    return "~xx" if word.islower() else "~xX"


@lru_cache(maxsize=4_096)
def index_vector(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of a name's sparse random index vector."""
    rng = np.random.default_rng(crc32(name.encode()))
    return rng.choice(DIM, NONZERO, replace=False), rng.choice([-1.0, 1.0], NONZERO)


class WordVectors:
    """The rows of known words and shapes, and their vectors (with squares) once these are set."""

    def __init__(self, words: list[str], shapes: list[str]):
        self.rows = {w: i for i, w in enumerate(dict.fromkeys([*words, *shapes, "~"]))}
        self.vectors = np.zeros((len(self.rows), 2 * DIM), np.float32)

    def row(self, word: str) -> int:
        i = self.rows.get(word)
        return i if i is not None else self.rows.get(shape(word), self.rows["~"])

    def neighbours(self, docs: list[np.ndarray], total: np.ndarray) -> None:
        """Adds to total (rows times DIM, flat) the index vectors of what stands beside each word of some texts (as rows)."""
        at, sign = self.indexes()
        for gap in range(1, WINDOW + 1):
            left = np.concatenate([x[:-gap] for x in docs if len(x) > gap] or [np.zeros(0, np.int64)])
            right = np.concatenate([x[gap:] for x in docs if len(x) > gap] or [np.zeros(0, np.int64)])
            for a, b in ((left, right), (right, left)):
                for k in range(NONZERO):
                    total += np.bincount(a * DIM + at[b, k], weights=sign[b, k], minlength=len(total))

    def indexes(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_indexes"):
            self._indexes = tuple(np.array(x) for x in zip(*map(index_vector, self.rows)))
        return self._indexes

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_indexes"}

    def set(self, total: np.ndarray) -> WordVectors:
        """Word vectors of summed neighbours; a little of a word's own shape keeps words apart that share their neighbours."""
        own = np.zeros_like(total)
        for name, i in self.rows.items():
            places, signs = index_vector(name if name[0] == "~" else shape(name))
            own[i, places] = signs
        unit = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
        self.vectors = np.concatenate([unit + 0.5 * own, (unit + 0.5 * own) ** 2], axis=1).astype(np.float32)
        return self


class _Known(dict):
    """An index for each distinct word met, and its row of the word vectors."""

    def __init__(self, vectors: WordVectors):
        self.vectors, self.rows = vectors, []

    def __missing__(self, word: str) -> int:
        self.rows.append(self.vectors.row(word))
        self[word] = at = len(self)
        return at


def features(texts: list[str | None], known: _Known) -> np.ndarray:
    if len(known) > KEPT:
        known.clear()
        known.rows.clear()
    words = [_TOKENS.findall(t) if t else [] for t in texts]
    lens = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter(map(known.__getitem__, (w for ws in words for w in ws)), np.int64, int(lens.sum()))
    rows, starts = np.array(known.rows, np.int64)[ids], np.cumsum(lens) - lens
    out = np.zeros((len(texts), FEATURES), np.float32)
    # Long texts are summed piece by piece, so that memory stays bounded.
    step = 65_536
    doc = np.repeat(np.arange(len(texts)), lens)
    for i in range(0, len(rows), step):
        part = doc[i : i + step]
        heads = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
        out[part[heads], : 2 * DIM] += np.add.reduceat(known.vectors.vectors[rows[i : i + step]], heads)
    for gap in (1, 2):  # index vectors of a word with itself: 1, of others: near 0
        same = (ids[:-gap] == ids[gap:]) & (doc[:-gap] == doc[gap:])
        out[:, 2 * DIM + gap - 1] = np.bincount(doc[:-gap][same], minlength=len(texts))[: len(texts)]
    out[:, :-1] /= np.maximum(lens, 1)[:, None]
    out[:, -1] = np.log1p(lens)
    return out


class Network:
    """Two layers, tanh between; full-batch Adam; a temperature fitted on held-back rows."""

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 10) -> Network:
        rng = np.random.default_rng(seed)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.w = None
        if len({*y.tolist()}) < 2:
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(x))
        back, own = order[: len(x) // 5], order[len(x) // 5 :]
        back = back if len(back) else own
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        a, b = x[own], y[own]
        for t in range(1, EPOCHS + 1):
            h = np.tanh(a @ w[0] + w[1])
            d = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - b) / len(b)
            dh = d[:, None] * w[2] * (1 - h * h)
            grads = [a.T @ dh + 1e-3 * w[0] / HIDDEN, dh.sum(0), h.T @ d + 1e-3 * w[2], np.array([d.sum()])]
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.w, self.temperature = w, 1.0
        z = self.logits(x[back])
        loss = lambda t: np.logaddexp(0, np.where(y[back] > 0, -z, z) / t).mean()
        self.temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits((x - self.mean) / self.scale) / self.temperature, -50, 50)))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    for batch in batches:
        for part in slices(batch, 1 << 20):
            yield part, [_TOKENS.findall(t) if t else [] for t in part["text"].to_pylist()]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts), pa.array(map(shape, counts), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "shape", "n"])

    counts: Counter = Counter()
    for _, docs in _texts(batches):
        for words in docs:
            counts.update(words)
        if len(counts) > AT_ONCE:
            yield counted()
            counts.clear()
    if counts:
        yield counted()


def _sum_neighbours(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total, held = np.zeros(len(known.rows) * DIM), []
        for _, docs in _texts(batches):
            held += [np.fromiter(map(known.row, words), np.int64, len(words)) for words in docs]
            if sum(map(len, held)) > AT_ONCE:
                known.neighbours(held, total)
                held = []
        known.neighbours(held, total)
        vectors = total.astype(np.int64).reshape(-1, DIM)
        some = np.flatnonzero(vectors.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.FixedSizeListArray.from_arrays(pa.array(vectors[some].reshape(-1)), DIM).cast(pa.list_(pa.int64()))], names=["row", "v"])

    return run


def _pool(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(shared.value)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                x = features(part["text"].to_pylist(), known)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["label"], pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[WordVectors, Network]:
    """Fits on documents with a label, except those held out (crc32 of the id, mod 5, is 0)."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "quality")
    marked = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = scratch.save(bounded_sample(marked.filter(~held_out(F.col("doc_id"), 5, 0)), max_train, F.lit(10), F.col("doc_id")))
    if chosen.count() <= 2 * max_train:
        chosen = F.broadcast(chosen)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    sample = scratch.save(texts.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text")).repartition(FIT_TASKS))

    counts = scratch.save(sample.select("text").mapInArrow(_count_words, "word string, shape string, n long").groupBy("word", "shape").agg(F.sum("n").alias("n")))
    words = counts.filter(F.col("n") >= MIN_COUNT).orderBy(F.desc("n"), "word").limit(MAX_VOCABULARY).select("word").toArrow()["word"].to_pylist()
    shapes = counts.groupBy("shape").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shape").limit(MAX_SHAPES).select("shape").toArrow()["shape"].to_pylist()
    vectors = WordVectors(words, sorted(shapes))
    shared = spark.sparkContext.broadcast(vectors)
    summed = sample.select("text").mapInArrow(_sum_neighbours(shared), "row long, v array<long>").groupBy("row").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIM)])
    total = np.zeros((len(vectors.rows), DIM))
    found = summed.toArrow()
    for i in range(DIM):
        total[found["row"].to_numpy(), i] = found[f"v{i}"].to_numpy()
    shared.destroy()
    shared = spark.sparkContext.broadcast(vectors.set(total))
    rows = sorted(sample.mapInArrow(_pool(shared), "doc_id long, label int, x binary").collect(), key=lambda r: r["doc_id"])
    shared.destroy()
    scratch.drop_all()
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, FEATURES)
    return vectors, Network().fit(x.astype(np.float64), np.array([r["label"] for r in rows], np.float64))


def score(docs: DataFrame, model: tuple[WordVectors, Network], columns: list[str] | None = None) -> DataFrame:
    """The named columns of docs (doc_id unless given) and the quality score of each whole text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    columns = ["doc_id"] if columns is None else [c for c in columns if c != "score"]
    given = docs.select(*columns, F.col("text").cast("string").alias("text")) if "text" not in columns else docs.select(*columns)
    schema = ", ".join(f"`{c}` {t}" for c, t in given.select(*columns).dtypes) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(shared.value)
        if key not in _caches:
            _caches.clear()
            _caches[key] = (shared.value, _Known(shared.value[0]))
        (_, network), known = _caches[key]
        for batch in batches:
            for part in slices(batch, 1 << 20):
                if len(part):
                    p = network.score(features(part["text"].to_pylist(), known).astype(np.float64))
                    yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), pa.array(p, pa.float64())], names=[*columns, "score"])

    return given.mapInArrow(run, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.withColumn("doc_id", F.col("doc_id").cast("long")), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
