"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Words, numbers by their length, words in capitals, runs of symbols and what repeats the token before it are tokens,
hashed into a fixed number of buckets. A bucket has a sparse random index vector of -1, 0 and 1; its context vector is the sum of the index
vectors two tokens to each side of it, over all documents. Sums are added up within a task, then slices of them in
two shuffles; what goes through the driver is the table of the buckets, whose size is fixed by ``buckets`` and ``dims``
whatever the corpus. A document's features are the mean of its tokens' vectors (index and context, frequent tokens
weighing less) and the logarithm of their number. A network of one hidden layer is fitted in NumPy on a bounded sample
of labelled documents (about ``max_rows``, one document an id), part of which is held back to stop in time and to fit the
temperature by which logits are divided, so that scores are probabilities.

Edge cases: null and empty texts have no tokens and the score of a document that says nothing; texts of any length are read
whole, some megabytes at a time; rows of equal text have equal scores; a null id is never learned from and counts as held
out; labels that are null or neither 0 nor 1 teach nothing, an id with several labels teaches their mean; without labels
the score is 0.5; an empty table gives no rows; further columns, of any names but the score's, are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from frameloom.llm.chunks import powers
from frameloom.llm.common import crc_fold, cut, fits, mix64, pieces, quoted, row_of, table

SPACE = re.compile(r"\s")
#: Buckets of tokens and dimensions of their vectors; index entries that aren't 0.
BUCKETS, DIMS, ENTRIES = 1 << 15, 64, 4
SLICE = 1 << 10
#: Characters and tokens that are worked on at once; sums of so many tasks are added up in the first shuffle.
PIECE, TOKENS, TASKS = 1 << 19, 1 << 16, 64
USUAL = 1e-3
#: Buckets of what is not told by its letters: a repeated token, one in capitals, a number of one to six digits or more.
REPEATED, CAPITALS = 0, 1
NUMBERS, OWN = np.arange(2, 8), 8
BLANK, LETTER, DIGIT, SYMBOL = range(4)
LONGEST_SYMBOL = 3
_kept: dict[str, object] = {}


@dataclass
class Characters:
    """By code point: its kind, whether it is a capital, and a random value that it shares with its lower case."""

    kind: np.ndarray
    capital: np.ndarray
    value: np.ndarray


def characters() -> Characters:
    if "characters" not in _kept:
        every = [chr(i) for i in range(0x110000)]
        kind = np.fromiter((BLANK if c.isspace() else LETTER if c.isalpha() else DIGIT if c.isdecimal() else SYMBOL for c in every), np.uint8, len(every))
        low = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in every), np.uint64, len(every))
        _kept["characters"] = Characters(kind, np.fromiter((c.isupper() for c in every), bool, len(every)), mix64(low + np.uint64(0x9E3779B97F4A7C15)))
    return _kept["characters"]


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the tokens of all texts, and where each text's begin; a token is hashed by sums of its characters' values."""
    table = characters()
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = table.kind[points]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start = np.r_[0, edge] if len(points) else edge
    end = np.r_[edge, len(points)] if len(points) else edge
    real = kind[start] != BLANK
    start, end = start[real], end[real]
    of = kind[start]
    n = end - start
    end = np.where(of == SYMBOL, np.minimum(end, start + LONGEST_SYMBOL), end)
    _, up, down = powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(table.value[points] * up[: len(points)], out=sums[1:])
    found = (mix64((sums[end] - sums[start]) * down[start]) % np.uint64(BUCKETS - OWN) + np.uint64(OWN)).astype(np.uint16)
    capitals = np.r_[0, np.cumsum(table.capital[points])]
    found[(of == LETTER) & (n > 1) & (capitals[end] - capitals[start] == n)] = CAPITALS
    found = np.where(of == DIGIT, NUMBERS[np.minimum(n, len(NUMBERS)) - 1], found).astype(np.uint16)
    begins = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    bounds = np.searchsorted(start, begins)
    again = np.r_[False, found[1:] == found[:-1]] if len(found) else np.empty(0, bool)
    again[bounds[bounds < len(found)]] = False
    found[again] = REPEATED
    return found, bounds


def token_runs(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the text, buckets of its tokens) in order; a text beyond PIECE comes in several runs, cut at white space."""
    texts = [t or "" for t in texts]
    for i, j in pieces([len(t) for t in texts], PIECE):
        if j - i == 1:
            start, text = 0, texts[i]
            while start < len(text):
                space = SPACE.search(text, start + PIECE) if len(text) - start > PIECE else None
                end = space.start() if space else len(text)
                yield i, tokens([text[start:end]])[0]
                start = end
            continue
        found, bounds = tokens(texts[i:j])
        for k in range(j - i):
            yield i + k, found[bounds[k] : bounds[k + 1]]


def index_entries() -> tuple[np.ndarray, np.ndarray]:
    """Where the random index vectors aren't 0, and their signs there; those of what lies outside a document are 0."""
    if "index" not in _kept:
        rng = np.random.default_rng(20130717)
        at = np.zeros((BUCKETS + 1, ENTRIES), np.int64)
        at[:BUCKETS] = rng.random((BUCKETS, DIMS)).argpartition(ENTRIES, axis=1)[:, :ENTRIES]
        sign = np.zeros((BUCKETS + 1, ENTRIES), np.int64)
        sign[:BUCKETS] = rng.choice(np.array([-1, 1]), (BUCKETS, ENTRIES))
        _kept["index"] = at, sign
    return _kept["index"]


def index_vectors() -> np.ndarray:
    at, sign = index_entries()
    out = np.zeros((BUCKETS, DIMS))
    np.put_along_axis(out, at[:BUCKETS], sign[:BUCKETS], axis=1)
    return out


class Contexts:
    """Sums of index vectors around each bucket, over a stream of tokens."""

    def __init__(self, reach: int = 2):
        self.reach = reach
        self.at, self.sign = index_entries()
        self.flat, self.counts = np.zeros((BUCKETS + 1) * DIMS, np.int64), np.zeros(BUCKETS + 1, np.int64)
        self.held, self.size = [np.full(reach, BUCKETS, np.uint16)], 0

    def add(self, texts: list[str | None]) -> None:
        last = None
        for i, found in token_runs(texts):
            if i != last:
                self.held.append(np.full(self.reach, BUCKETS, np.uint16))
            last = i
            self.held.append(found)
            self.size += len(found)
            if self.size > TOKENS:
                self.flush()

    def flush(self) -> None:
        """Adds up all held tokens, each with those before it; the last ones are kept, as others may follow."""
        x = np.concatenate(self.held).astype(np.int64)
        new = x[self.reach :]
        for k in range(1, self.reach + 1):
            before = x[self.reach - k : len(x) - k]
            for one, other in ((new, before), (before, new)):
                np.add.at(self.flat, (one[:, None] * DIMS + self.at[other]).ravel(), self.sign[other].ravel())
        self.counts += np.bincount(new, minlength=BUCKETS + 1)
        self.held, self.size = [x[len(x) - self.reach :].astype(np.uint16)], 0

    def table(self) -> np.ndarray:
        """A row a bucket: how often it is there, and its context vector."""
        return np.concatenate([self.counts[:BUCKETS, None], self.flat.reshape(-1, DIMS)[:BUCKETS]], axis=1)


def slices(table: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for i in range(0, BUCKETS, SLICE):
        part = table[i : i + SLICE]
        if part.any():
            yield i // SLICE, part.tobytes()


SUMS = "slice int, turn int, sums binary"


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each (slice, turn), which come sorted: one slice is held at a time."""
    key, total = None, np.empty(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "turn", "sums"])

    for b in batches:
        for s, t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            part = np.frombuffer(x.as_buffer(), np.int64)
            if key == (s, t):
                total = total + part
                continue
            if key:
                yield out()
            key, total = (s, t), part.copy()
    if key:
        yield out()


def context_sums(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(counts, context vectors) of all buckets over all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = Contexts()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                contexts.add(b.column(0).slice(i, 256).to_pylist())
        contexts.flush()
        turn = TaskContext.get().partitionId() // TASKS
        for s, x in slices(contexts.table()):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([turn], pa.int32()), pa.array([x], pa.binary())], ["slice", "turn", "sums"])

    made = docs.select(F.col(quoted(text)).cast("string")).mapInArrow(counted, SUMS)
    some = made.repartition("slice", "turn").sortWithinPartitions("slice", "turn").mapInArrow(added, SUMS)
    whole = some.withColumn("turn", F.lit(0)).repartition("slice").sortWithinPartitions("slice").mapInArrow(added, SUMS)
    rows = whole.collect()  # BUCKETS / SLICE of them
    out = np.zeros((BUCKETS // SLICE, SLICE, DIMS + 1), np.int64)
    for r in rows:
        out[r.slice] = np.frombuffer(r.sums, np.int64).reshape(SLICE, DIMS + 1)
    out = out.reshape(BUCKETS, DIMS + 1)
    return out[:, 0], out[:, 1:]


def word_vectors(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Index and context vector of each bucket, of length 1 each, times its weight."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    total = max(1, counts.sum())
    mean = sums.sum(axis=0) / total
    context = unit(sums / np.maximum(counts, 1)[:, None] - mean) * (counts > 0)[:, None]
    weight = USUAL / (USUAL + counts / total)
    return (np.concatenate([unit(index_vectors()), context], axis=1) * weight[:, None]).astype(np.float32)


def features(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row for each text: the mean vector of its tokens and the logarithm of their number."""
    out, n = np.zeros((len(texts), vectors.shape[1] + 1)), np.zeros(len(texts))
    for i, found in token_runs(texts):
        for k in range(0, len(found), TOKENS):
            out[i, :-1] += np.add.reduce(vectors[found[k : k + TOKENS]], axis=0)
        n[i] += len(found)
    out[:, :-1] /= np.maximum(n, 1)[:, None]
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Model:
    """vectors of tokens; centre and scale of features; both layers; the temperature."""

    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.centre) / self.scale @ w1 + b1, 0) @ w2 + b2

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return chances(self.logits(features(texts, self.vectors)) / self.temperature).round(9)


def chances(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -60, 60)))


def loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits)) if len(y) else 0.0


def gradient(x: np.ndarray, y: np.ndarray, layers: list[np.ndarray], decay: float) -> list[np.ndarray]:
    w1, b1, w2, b2 = layers
    h = np.maximum(x @ w1 + b1, 0)
    d = (chances(h @ w2 + b2) - y) / len(y)
    back = np.outer(d, w2) * (h > 0)
    return [x.T @ back + decay * w1, back.sum(axis=0), h.T @ d + decay * w2, np.array(d.sum())]


def fitted(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, patience: int = 8, seed: int = 13) -> Model:
    """The network by Adam on four fifths of the rows, stopped and calibrated by the others."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, learn = order[: len(y) // 5], order[len(y) // 5 :]
    centre, scale = x[learn].mean(axis=0), np.maximum(x[learn].std(axis=0), 1e-6)
    z = (x - centre) / scale
    share = min(max(y[learn].mean(), 1e-3), 1 - 1e-3)
    layers = [rng.normal(size=(x.shape[1], hidden)) * math.sqrt(2 / x.shape[1]), np.zeros(hidden), rng.normal(size=hidden) * math.sqrt(1 / hidden), np.array(math.log(share / (1 - share)))]
    first, second = ([np.zeros_like(w) for w in layers] for _ in range(2))
    best, kept, since, t = math.inf, layers, 0, 0
    apply = lambda rows, layers: np.maximum(z[rows] @ layers[0] + layers[1], 0) @ layers[2] + layers[3]
    for _ in range(rounds):
        rng.shuffle(learn)
        for i in range(0, len(learn), batch):
            rows, t = learn[i : i + batch], t + 1
            for k, g in enumerate(gradient(z[rows], y[rows], layers, decay)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] = layers[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        now = loss(apply(held, layers), y[held]) if len(held) else 0.0
        best, kept, since = (now, list(layers), 0) if now < best else (best, kept, since + 1)
        if since >= patience:
            break
    return Model(vectors, centre, scale, kept, temperature(apply(held, kept), y[held]))


def temperature(logits: np.ndarray, y: np.ndarray, steps: int = 60) -> float:
    """The temperature of least loss, by golden section over its logarithm."""
    if not len(y):
        return 1.0
    lo, hi, golden = math.log(0.5), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(steps):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        lo, hi = (lo, b) if loss(logits / math.exp(a), y) < loss(logits / math.exp(b), y) else (a, hi)
    return math.exp((lo + hi) / 2)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", max_rows: int = 20000, **how) -> Model | None:
    """A model from docs(key, text), all of which shape the vectors, and labels(key, label), about max_rows of which teach."""
    named = labels.select(F.col(key).cast("long").alias("k"), F.col("label").cast("double").alias("label")).where("k is not null and label in (0, 1)")
    named = cut(named.groupBy("k").agg(F.avg("label").alias("label")))
    n = named.count()
    if not n:
        return None
    drawn = named.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < min(1.0, max_rows / n) * (1 << 20))
    drawn = F.broadcast(drawn) if fits(drawn, 32) else drawn
    vectors = word_vectors(*context_sums(docs, text))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # of a fixed size

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, j in pieces([len(t or "") for t in texts], PIECE):
                x = features(texts[i:j], shared.value).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["k", "label", "x"])

    mine = docs.select(F.col(key).cast("long").alias("id"), F.col(quoted(text)).cast("string").alias("t"))
    taught = mine.join(drawn, F.col("id") == F.col("k")).select("k", "label", "t").mapInArrow(pooled, "k long, label double, x binary")
    rows = taught.groupBy("k").agg(F.min(F.struct("x", "label")).alias("r")).select("k", "r.*").collect()  # of rows that share an id, one
    if not rows:
        return None
    rows.sort(key=lambda r: r.k)
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(len(rows), -1).astype(np.float64)
    return fitted(vectors, x, np.array([r.label for r in rows]), **how)


def scored(docs: DataFrame, model: Model | None, text: str = "text", score: str = "score") -> DataFrame:
    """Adds the score to docs; a column of that name is replaced."""
    names = [c for c in docs.columns if c != score]
    packed = docs.select(row_of(docs.select(*[F.col(quoted(c)) for c in names]), **{text: F.col(quoted(text)).cast("string")}).alias("row"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column(0).field(text).to_pylist(), []
            for i, j in pieces([len(t or "") for t in texts], PIECE):
                out.append(np.full(j - i, 0.5) if shared.value is None else shared.value.scores(texts[i:j]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else [], pa.float64())], ["row", score])

    schema = StructType([*packed.schema.fields, StructField(score, DoubleType())])
    return packed.mapInArrow(told, schema).select(*[F.col("row")[c].alias(c) for c in names], score)


def held_out(key: Column, folds: int = 5) -> Column:
    return F.coalesce(crc_fold(key, folds) == 0, F.lit(True))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~held_out(F.col("doc_id")))
    out = scored(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {"op13_quality": op13_quality}
ORACLES: dict[str, str] = {}
