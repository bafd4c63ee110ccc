"""Quality classifier: random-indexing word vectors, pooled, under a small network.

A word's vector sums the sparse random index vectors of the words around it. A document is the
mean of its words' vectors and of those of its words' outlines (first and last characters by
class). A two-layer network scores it; a temperature fitted on rows it did not train on makes
scores probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

SAMPLE = 8000        # expected labelled rows that vectors and network are fitted on, at most
BUCKETS = 1 << 13    # words by hash, and as many again for outlines
WIDTH = 32           # numbers of a vector
NONZERO = 4          # of an index vector
WINDOW = 2
HIDDEN = 32
STEPS = 400
RATE = 0.01
DECAY = 1e-4
CALIBRATE = 5        # one row in so many is kept from training, to fit the temperature
THRESHOLD = 0.7
BLOCK = 1 << 18      # words pooled at once

_CLASSES = bytes(
    ord("a") if 0x61 <= b <= 0x7A or b >= 0x80 else ord("A") if 0x41 <= b <= 0x5A
    else ord("0") if 0x30 <= b <= 0x39 else b for b in range(256))


def buckets(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of a text's words, and of their outlines."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    of_word = np.fromiter(map(zlib.crc32, words), np.uint32, n) % np.uint32(BUCKETS)
    lines = raw.translate(_CLASSES).split()
    of_line = np.fromiter((zlib.crc32(w[:1] + w[-2:]) for w in lines), np.uint32, n) \
        % np.uint32(BUCKETS)
    return of_word.astype(np.int64), of_line.astype(np.int64) + BUCKETS


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of every bucket's index vector."""
    rng = np.random.default_rng(7)
    shape = (2 * BUCKETS, NONZERO)
    return rng.integers(0, WIDTH, shape), rng.choice([-1.0, 1.0], shape)


def context_sums(texts: list[str], position: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Sums of the neighbours' index vectors (buckets x width, flat); outlines neighbour words."""
    total = np.zeros(2 * BUCKETS * WIDTH)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for text in texts:
        w, l = buckets(text)
        for seq in (w, l):
            pairs.append((seq, seq))
            for d in range(1, WINDOW + 1):
                pairs += [(seq[d:], seq[:-d]), (seq[:-d], seq[d:])]
        pairs += [(l, w)]
    target = np.concatenate([p[0] for p in pairs] or [np.zeros(0, np.int64)])
    source = np.concatenate([p[1] for p in pairs] or [np.zeros(0, np.int64)])
    for k in range(NONZERO):
        total += np.bincount(target * WIDTH + position[source, k], weights=sign[source, k],
                             minlength=len(total))
    return total


def word_vectors(sample: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets (2 * BUCKETS x WIDTH), from the texts of sample (column t).

    The cells are summed by Spark; the driver gets a table whose size the buckets bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        position, sign = index_vectors()
        total = np.zeros(2 * BUCKETS * WIDTH)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 200):
                total += context_sums(texts[at:at + 200], position, sign)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])],
                                         names=["cell", "v"])

    cells = sample.select("t").mapInArrow(run, "cell long, v double").groupBy("cell").agg(
        F.sum("v").alias("v")).toArrow()
    flat = np.zeros(2 * BUCKETS * WIDTH)
    flat[cells.column("cell").to_numpy()] = cells.column("v").to_numpy()
    vectors = flat.reshape(-1, WIDTH)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Mean vectors of words and of outlines side by side; zeros for a text without words."""
    out = np.zeros((len(texts), 2 * WIDTH))
    for i, text in enumerate(texts):
        w, l = buckets(text)
        if len(w):
            for at in range(0, len(w), BLOCK):
                out[i, :WIDTH] += vectors[w[at:at + BLOCK]].sum(0)
                out[i, WIDTH:] += vectors[l[at:at + BLOCK]].sum(0)
            out[i] /= len(w)
    return out


class Network:
    """Standardise, one hidden tanh layer, one logit, divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray):
        rng = np.random.default_rng(11)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.std
        n, width = z.shape
        self.p = [rng.normal(0, width ** -0.5, (width, HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        fit = ~keep if (~keep).any() else np.ones(n, bool)
        a, b = z[fit], y[fit]
        m = [np.zeros_like(q) for q in self.p]
        v = [np.zeros_like(q) for q in self.p]
        for step in range(1, STEPS + 1):
            h = np.tanh(a @ self.p[0] + self.p[1])
            d = (self._sigmoid(h @ self.p[2] + self.p[3]) - b) / len(b)
            dh = np.outer(d, self.p[2]) * (1 - h * h)
            grads = [a.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]
            for q, g, mi, vi in zip(self.p, grads, m, v):
                g = g + DECAY * q
                mi += 0.1 * (g - mi)
                vi += 0.001 * (g * g - vi)
                q -= RATE * (mi / (1 - 0.9 ** step)) / (np.sqrt(vi / (1 - 0.999 ** step)) + 1e-8)
        self.temperature = self._calibrate(z[keep], y[keep])

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))

    def _logit(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> float:
        """The temperature of least log-loss on rows kept from training."""
        if not len(y):
            return 1.0
        logit = self._logit(z)
        grid = np.geomspace(0.1, 10, 81)
        loss = [-np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-9, 1)).mean()
                for p in (self._sigmoid(logit / t) for t in grid)]
        return float(grid[int(np.argmin(loss))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid(self._logit((x - self.mean) / self.std) / self.temperature)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, Network] | None:
    """Word vectors and network from about `sample` labelled rows, or None without any.

    Rows are chosen by a hash of their key. A key labelled twice counts with its larger label;
    null keys and labels teach nothing, null texts count as empty.
    """
    truth = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(key).alias("k")).agg((F.max(label) >= 1).cast("int").alias("y"))
    n = truth.count()
    if not n:
        return None
    share = min(1.0, sample / n)
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")).where(
        draw < share).join(truth.where(draw < share), "k")
    rows = c.cut(rows)
    vectors = word_vectors(rows)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(cols: dict[str, pa.Array]) -> dict[str, list]:
        return {"k": cols["k"], "y": cols["y"],
                "x": list(pooled(cols["t"].to_pylist(), shared.value))}

    got = c.map_arrow(rows.select(F.col("k").cast("long"), "y", "t"), pool,
                      "k long, y int, x array<double>").toArrow().sort_by("k")
    c.discard(rows)
    if not got.num_rows:
        return None
    x = np.array(got.column("x").to_pylist())
    y = got.column("y").to_numpy()
    order = np.lexsort((*x.T[::-1], got.column("k").to_numpy()))
    x, y = x[order], y[order]
    keep = np.arange(len(y)) % CALIBRATE == 0
    return vectors, Network(x, y.astype(float), keep)


def score(docs: DataFrame, model: tuple[np.ndarray, Network] | None, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(key, score) of every row: probability of label 1 from the whole text.

    Null and empty texts, and texts of white space, share the score of the zero vector; without
    a model every score is 0.5. Repeated rows come back as often as they came, and keys may be null
    or shared. A very long text is pooled whole, in blocks of words; other columns are left out,
    whatever their names.
    """
    vectors = docs.sparkSession.sparkContext.broadcast(model[0] if model else None)
    network = model[1] if model else None

    def rows(cols: dict[str, pa.Array]) -> dict[str, list]:
        texts = cols["t"].to_pylist()
        if network is None:
            return {"id": cols["id"], "score": [0.5] * len(texts)}
        return {"id": cols["id"], "score": network.score(pooled(texts, vectors.value))}

    found = c.map_arrow(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")),
                        rows, "id long, score double")
    return found.withColumnRenamed("id", key)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels")
    held = F.coalesce(c.remainder("doc_id", 4) == 2, F.lit(False))
    model = train(docs, labels.where(~held))
    return score(docs, model).select(
        "doc_id", held.alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
