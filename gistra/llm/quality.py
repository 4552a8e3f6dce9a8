"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Every token has a sparse random index vector, seeded by its own hash. A word's vector is the normalised sum
of the index vectors near it in the training sample, plus its own. Tokens also have a shape (lower, title,
upper, digits, symbols) and a repeat mark when they equal the token before, each a token of its own in that
space, so words never seen in training still say how they are written. A document is the mean of its
tokens' vectors; the network reads it standardised, and its temperature is fitted on a part of the sample
that the weights have not seen.

Fitting takes at most ``per_class`` labelled rows of each class (documented bound). Words that come ``SEEN`` times
or more in that sample have vectors of their own, however many they are; any other token is its shape. Every whole
text is scored in one narrow pass without shuffle, with a bounded cache of word rows.

Defined cases: texts without tokens are scored as the zero vector; without rows of both classes to learn
from every score is 0; input columns stay (new ones get a leading underscore on a name clash).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistra.llm.labelled import fold, training_sample
from gistra.llm.text import column, ensure_unique, slices

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
PER_CLASS = 1500
DIM, NONZERO, REACH, UNITS, SEEN = 32, 4, 2, 16, 5
CACHE_WORDS = 300_000
SLICE = 1 << 20
SHAPES = ["<lower>", "<title>", "<upper>", "<digit>", "<symbol>"]
REPEAT = "<repeat>"

tokens_of = re.compile(r"\w+|[^\w\s]+").findall


def shape(token: str) -> int:
    if token.islower():
        return 0
    if token.isupper() and len(token) > 1:
        return 2
    if token[0].isalpha():
        return 1
    return 3 if token[0].isdigit() else 4


def index_vector(token: str) -> np.ndarray:
    r = np.random.default_rng(zlib.crc32(token.encode()))
    v = np.zeros(DIM, np.float32)
    v[r.choice(DIM, NONZERO, replace=False)] = r.choice([-1.0, 1.0], NONZERO)
    return v


class Space:
    """Vectors of the vocabulary and of the shapes; anything else is its shape alone."""

    def __init__(self, texts: list[list[str]]):
        count = Counter(t.lower() for ts in texts for t in ts)
        words = sorted(w for w in count if count[w] >= SEEN)
        self.vocab = {w: i + 1 for i, w in enumerate(words)}
        self.shapes = np.array([index_vector(s) for s in SHAPES])
        self.repeat = index_vector(REPEAT)
        own = np.concatenate([np.zeros((1, DIM), np.float32), *[index_vector(w)[None] for w in words]])
        near = np.zeros_like(own)
        for ts in texts:
            ids = np.array([self.vocab.get(t.lower(), 0) for t in ts], int)
            for d in range(1, REACH + 1):
                np.add.at(near, ids[d:], own[ids[:-d]])
                np.add.at(near, ids[:-d], own[ids[d:]])
        near[0] = 0
        norm = np.linalg.norm(near, axis=1, keepdims=True)
        self.vectors = (near / np.maximum(norm, 1e-9) + 0.5 * own).astype(np.float32)

    def row(self, token: str) -> np.ndarray:
        return self.vectors[self.vocab.get(token.lower(), 0)] + self.shapes[shape(token)]


class Pool:
    """Pools lists of texts, with a bounded table of the rows of tokens met so far."""

    def __init__(self, space: Space):
        self.space = space
        self._clear()

    def _clear(self):
        self.ids: dict[str, int] = {}
        self.table = np.zeros((0, DIM), np.float32)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.ids) > CACHE_WORDS:
            self._clear()
        split = [tokens_of(t) for t in texts]
        new = list({t for ts in split for t in ts if t not in self.ids})
        if new:
            self.ids.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            rows = self.space.vectors[[self.space.vocab.get(t.lower(), 0) for t in new]] + self.space.shapes[[shape(t) for t in new]]
            self.table = np.concatenate([self.table, rows])
        out = np.zeros((len(texts), DIM), np.float32)
        for i, ts in enumerate(split):
            if ts:
                ids = np.fromiter(map(self.ids.__getitem__, ts), int, len(ts))
                # distinct rows weighted by count: one long document needs no row for each token
                kinds, n = np.unique(ids, return_counts=True)
                out[i] = (n.astype(np.float32) @ self.table[kinds] + (ids[1:] == ids[:-1]).sum() * self.space.repeat) / len(ts)
        return out


class Net:
    """DIM -> tanh UNITS -> 1, with standardisation in front and a temperature behind."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 1500, seed: int = 5):
        r = np.random.default_rng(seed)
        mix = r.permutation(len(y))
        fit, held = mix[len(y) // 5 :], mix[: len(y) // 5]
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
        self.p = [r.normal(size=(x.shape[1], UNITS)) * 0.3, np.zeros(UNITS), r.normal(size=UNITS) * 0.3, np.zeros(1)]
        weight = np.where(y > 0, 0.5 / max(y[fit].mean(), 1e-9), 0.5 / max(1 - y[fit].mean(), 1e-9))
        m, v = [0 * q for q in self.p], [0 * q for q in self.p]
        for k in range(1, steps + 1):
            j = r.choice(fit, min(256, len(fit)), replace=False)
            xs = (x[j] - self.mean) / self.scale
            h = np.tanh(xs @ self.p[0] + self.p[1])
            d = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - y[j]) * weight[j] / len(j)
            dh = d[:, None] * self.p[2] * (1 - h * h)
            for i, g in enumerate([xs.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]):
                g = g + 1e-4 * self.p[i]
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                self.p[i] = self.p[i] - 0.01 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
        self.temperature = 1.0
        if len(held):
            z, grid = self.logit(x[held]), np.exp(np.linspace(-1.5, 2, 60))
            loss = [np.mean(weight[held] * np.logaddexp(0, np.where(y[held] > 0, -z, z) / t)) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x):
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def __call__(self, x):
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def fit(sample: list[tuple[str, int]]) -> tuple[Space, Net] | None:
    y = np.array([y for _, y in sample], float)
    if len(set(y.tolist())) < 2:
        return None
    space = Space([tokens_of(t) for t, _ in sample])
    return space, Net(Pool(space)([t for t, _ in sample]), y)


def score_documents(docs: DataFrame, model: tuple[Space, Net] | None, text_col: str = "text") -> DataFrame:
    """``docs`` with a quality column (double, 0 to 1)."""
    name = ensure_unique(docs.columns, ["quality"])["quality"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        pool = Pool(shared.value[0]) if shared.value else None
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                got = shared.value[1](pool([x or "" for x in column(part, text_col).to_pylist()])) if pool else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], [*part.schema.names, name])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def model_for(docs: DataFrame, labels: DataFrame) -> tuple[Space, Net] | None:
    return fit(training_sample(docs, labels, "quality", FOLDS, HELD_OUT, PER_CLASS))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_documents(docs, model_for(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= THRESHOLD).cast("int").alias("predicted"))
