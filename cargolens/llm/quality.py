"""Quality classifier: random-indexing word vectors and a small network (operator 1).

*Words* are runs of letters, runs of digits and single signs, folded to lower case and hashed to
``BUCKETS`` rows.  *Random indexing*: every row has a fixed sparse index vector of +1 and -1; a row's context
vector is the sum of its neighbours' index vectors over the training texts (``REACH`` words to each side).
*Pooling*: a document is the mean and the spread of its words' vectors, with a few ratios (signs,
capitals, repeated words, length).  *Network*: two layers in numpy, trained on part of the training rows; the rest of
them sets the temperature by which logits are divided, so that scores are probabilities.

Only labelled rows of the training fold are ever used for fitting (``held_out``: crc32 of the id as text, mod 4, is
2), at most about ``SAMPLE`` of them, chosen by a hash of the id.  Scoring reads each whole text once
in its own partition; what is broadcast has a fixed size (``BUCKETS`` x ``WIDTH`` numbers and the network).

Defined cases: null text is the empty text and gets a score like any other; without labelled
training rows every score is 0.5, with only one label the smoothed share of that label; a repeated
label row counts once for each label it gives, repeated documents are scored each; an empty table gives an empty
result; lang, source and other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import bounded_sample, cut, fresh, importable_on_workers

BUCKETS = 1 << 13
WIDTH = 32
NONZERO = 4
REACH = 2
SAMPLE = 6000
FIT_TASKS = 8
HIDDEN = 24
EPOCHS = 60
THRESHOLD = 0.7
EXTRA = 8
FEATURES = 2 * 2 * WIDTH + EXTRA

_find = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]").findall


def fold(id_col: str, parts: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(20240917)
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for k in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, WIDTH, BUCKETS)] += rng.choice([-1.0, 1.0], BUCKETS)
    return out


def row_of(word: str, cache: dict[str, int]) -> int:
    r = cache.get(word)
    if r is None:
        if len(cache) >= 100_000:
            cache.clear()
        r = cache[word] = zlib.crc32(word.lower().encode()) % BUCKETS
    return r


def context_sums(texts: list[str], cache: dict[str, int]) -> np.ndarray:
    """The texts' contribution to the context vectors."""
    index = index_vectors()
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for text in texts:
        rows = np.array([row_of(w, cache) for w in _find(text)], np.int64)
        for step in range(1, REACH + 1):
            # Neighbours in both directions; pairs are counted first, so a repeated pair is added once.
            pair, n = np.unique(rows[:-step] * BUCKETS + rows[step:], return_counts=True)
            a, b, n = pair // BUCKETS, pair % BUCKETS, n.astype(np.float32)[:, None]
            np.add.at(out, a, index[b] * n)
            np.add.at(out, b, index[a] * n)
    return out


def word_vectors(context: np.ndarray) -> np.ndarray:
    """Index and context vectors side by side, both of length 1 (or 0)."""
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    own = index_vectors()
    return np.hstack([own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9), context / np.maximum(norm, 1e-9)]).astype(np.float32)


def pooled(text: str, vectors: np.ndarray, cache: dict[str, int]) -> np.ndarray:
    out = np.zeros(FEATURES, np.float32)
    words = _find(text)
    if not words:
        return out
    counts = Counter(words)
    rows = np.array([row_of(w, cache) for w in counts], np.int64)
    n = np.fromiter(counts.values(), np.float32, len(counts))
    total = float(n.sum())
    v = vectors[rows]
    share = n / total
    mean = share @ v
    out[: 2 * WIDTH] = mean
    out[2 * WIDTH: 4 * WIDTH] = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
    signs = sum(c for w, c in counts.items() if not w[0].isalnum())
    upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    runs = sum(a == b for a, b in zip(words, words[1:])) if len(words) > 1 else 0
    out[4 * WIDTH:] = [signs / total, upper / total, runs / total, len(counts) / total, np.log1p(total) / 10,
                       float(n.max()) / total, sum(map(len, words)) / total / 10, text.count("\n") / total]
    return out


class Network:
    """Two layers, tanh inside, one logit; inputs are standardised, the logit is divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray):
        train = ~calibrate
        self.mean, self.scale = x[train].mean(0), x[train].std(0) + 1e-3
        rng = np.random.default_rng(7)
        w1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN))
        p = [w1, np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        z, t = self._inputs(x[train]), y[train].astype(float)
        m, v, k = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for a in range(0, len(z), 64):
                i = order[a: a + 64]
                h = np.tanh(z[i] @ p[0] + p[1])
                d = (_sigmoid(h @ p[2] + p[3]) - t[i]) / len(i)
                dh = np.outer(d, p[2]) * (1 - h * h)
                grads = [z[i].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
                k += 1
                for j, g in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    p[j] -= 0.005 * (m[j] / (1 - 0.9 ** k)) / (np.sqrt(v[j] / (1 - 0.999 ** k)) + 1e-8)
        self.p, self.temperature = p, 1.0
        held = self.logits(x[calibrate])
        if len(held):
            self.temperature = best_temperature(held, y[calibrate])

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logits(self, x: np.ndarray) -> np.ndarray:
        # Row by row sums, so that a document's score doesn't depend on which batch it is in.
        h = np.tanh(np.einsum("ij,jk->ik", self._inputs(x), self.p[0], optimize=False) + self.p[1])
        return (np.einsum("ik,k->i", h, self.p[2], optimize=False) + self.p[3]) / self.temperature if len(x) else np.zeros(0)


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least cross entropy on rows that were not fitted.

    The loss is convex in 1 / temperature, so its slope is followed to where it changes sign, however far.  One row of each label is
    added in thought (as Platt does), which keeps the least loss finite where the labels are told apart without a mistake.
    """
    n1 = float(y.sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))

    def slope(sharpness: float) -> float:
        return float(np.mean(logits * (_sigmoid(logits * sharpness) - t)))

    low, high = 0.0, 1.0
    if slope(low) >= 0:  # the logits tell nothing
        return 1.0
    while slope(high) < 0:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) < 0 else (low, middle)
    return 2 / (low + high)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _context_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, cache = np.zeros((BUCKETS, WIDTH), np.float32), {}
    for batch in batches:
        total += context_sums(batch.column(0).to_pylist(), cache)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The word vectors and the network, or the share of good rows where only one label is known."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col("quality").cast("int").alias("y")).where(
        "y in (0, 1) and _id is not null").where(fold("_id", 4) != 2).distinct()
    marks = bounded_sample(marks, "_id", SAMPLE, 1)
    rows = cut(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
               .join(F.broadcast(marks), F.col("id") == F.col("_id"))  # about SAMPLE rows
               .select("id", "text", "y", (fold("_id", 20) < 4).alias("calibrate")).repartition(FIT_TASKS))
    sums = [np.frombuffer(r["sums"], np.float32) for r in rows.select("text").mapInArrow(lambda b: _context_task(fresh(b)), "sums binary").collect()]  # FIT_TASKS rows
    context = sum(sums, np.zeros(BUCKETS * WIDTH, np.float32)).reshape(BUCKETS, WIDTH)
    vectors = word_vectors(context)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            x = [pooled(t, shared.value, cache).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), b.column(2), b.column(3)], names=["id", "x", "y", "calibrate"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(features, f"id {kind}, x binary, y int, calibrate boolean").collect()  # about SAMPLE rows of FEATURES numbers
    shared.destroy()
    got.sort(key=lambda r: (str(r["id"]), r["y"], r["x"]))
    y = np.array([r["y"] for r in got], np.int64)
    if len(set(y.tolist())) < 2:
        return {"share": float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5}
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got]).astype(np.float64)
    calibrate = np.array([r["calibrate"] for r in got])
    if len(set(y[~calibrate].tolist())) < 2:
        calibrate[:] = False
    return {"vectors": vectors, "network": Network(x, y, calibrate)}


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every row."""
    held = F.coalesce(fold(id_col, 4) == 2, F.lit(False)).alias("held_out")
    if "share" in model:
        s = F.lit(model["share"])
        return docs.select(id_col, held, s.alias("score"), (s >= threshold).cast("int").alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        vectors, network = shared.value["vectors"], shared.value["network"]
        for b in batches:
            x = np.zeros((len(b), FEATURES))
            for i, text in enumerate(b.column(2)):
                x[i] = pooled(text.as_py(), vectors, cache)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_sigmoid(network.logits(x)), pa.float64())],
                                             names=["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("id"), held, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(lambda b: scores(fresh(b)), f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    importable_on_workers(docs.sparkSession)
    return score(docs, fit(docs, labels), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that are likelier good than bad, with all their columns.

    The texts are scored where they are read, so nothing is joined.  Without rows of both
    labels nothing can be told apart and all stay.
    """
    importable_on_workers(docs.sparkSession)
    model = fit(docs, labels)
    if "share" in model:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        vectors, network = shared.value["vectors"], shared.value["network"]
        for b in batches:
            x = np.zeros((len(b), FEATURES))
            for i, text in enumerate(b.column(at)):
                x[i] = pooled(text.as_py() or "", vectors, cache)
            yield b.filter(pa.array(_sigmoid(network.logits(x)) >= threshold))

    return docs.mapInArrow(lambda b: good(fresh(b)), docs.schema)
