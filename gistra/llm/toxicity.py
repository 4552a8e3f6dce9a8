"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own embedding (if the training sample has it often enough) plus the mean embedding
of its hashed character trigrams, so unseen spellings still have an input. Texts are cut into overlapping
windows; all of them are scored and the highest window decides the document. A run of more than ``LONGEST``
letters and digits (scripts without blanks, junk) is read as consecutive words that overlap by two characters:
all its trigrams are read and windows cover the whole run.

Only documents are labelled, so fitting is multiple-instance: a document's window of highest score stands
for it, first by smoothed log-odds of its words (which also start the first embedding coordinate), then by
the network itself.

Fitting takes at most ``per_class`` labelled rows of each class (documented bound). Scoring is one narrow
pass without shuffle; each task has the model (about 1 MB) and a bounded cache of word inputs.

Defined cases: null, empty and wordless texts get the score of an empty window; without rows of both
classes to learn from every score is 0; all input columns stay (new ones get a leading underscore on a
name clash).
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

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
PER_CLASS = 1500
WINDOW, STRIDE = 32, 24
DIM, HIDDEN, TRIGRAMS = 10, 8, 2048
CACHE_WORDS = 150_000
LONGEST = 40

_words = re.compile(r"[^\W_]+").findall


def words_of(text: str) -> list[str]:
    words = _words(text.lower())
    if len(max(words, key=len, default="")) <= LONGEST:
        return words
    return [w[i : i + LONGEST] for w in words for i in range(0, max(len(w) - 2, 1), LONGEST - 2)]


def trigrams(word: str) -> list[int]:
    w = f"<{word}>"
    return [zlib.crc32(w[i : i + 3].encode()) % TRIGRAMS for i in range(len(w) - 2)]


def window_starts(n: int) -> np.ndarray:
    """Where windows begin in a text of ``n`` words: overlapping, all words covered, one window at least."""
    return np.arange(0, max(n - (WINDOW - STRIDE), 1), STRIDE)


def windows(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of each window (0 pads) and each window's document."""
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, int)
    counts = np.maximum(-(-np.maximum(lengths - (WINDOW - STRIDE), 1) // STRIDE), 1)
    doc = np.repeat(np.arange(len(lengths)), counts)
    within = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
    at = within[:, None] + np.arange(WINDOW)
    ok = at < lengths[doc][:, None]
    padded = np.append(ids, 0)
    return np.where(ok, padded[np.where(ok, begins[doc][:, None] + at, len(ids))], 0), doc


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Gru:
    """One direction over projected inputs [B, T, 3H]; gates in the order z, r, n."""

    @staticmethod
    def forward(x, mask, u, keep=False):
        b, steps, h3 = x.shape
        h = h3 // 3
        state, out, saved = np.zeros((b, h), x.dtype), np.empty((b, steps, h), x.dtype), []
        for t in range(steps):
            hu = state @ u
            zr = _sigmoid(x[:, t, : 2 * h] + hu[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[:, t, 2 * h :] + r * hu[:, 2 * h :])
            m = mask[:, t, None]
            if keep:
                saved.append((state, z, r, n, hu[:, 2 * h :]))
            state = state + m * (1 - z) * (n - state)
            out[:, t] = state
        return out, saved

    @staticmethod
    def backward(dout, mask, u, saved):
        b, steps, h = dout.shape
        dx, du, ds = np.zeros((b, steps, 3 * h), dout.dtype), np.zeros_like(u), np.zeros((b, h), dout.dtype)
        for t in reversed(range(steps)):
            state, z, r, n, hn = saved[t]
            ds = ds + dout[:, t]
            g = ds * mask[:, t, None]
            dn = g * (1 - z) * (1 - n * n)
            dz = -g * (n - state) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            dhu = np.concatenate([dz, dr, dn * r], 1)
            dx[:, t] = np.concatenate([dz, dr, dn], 1)
            du += state.T @ dhu
            ds = ds - g * (1 - z) + dhu @ u.T
        return dx, du


class Model:
    """Weights ``p`` and the vocabulary; rows of ``inputs`` are words' summed embeddings."""

    def __init__(self, vocab: dict[str, int], seed: int = 7):
        r = np.random.default_rng(seed)
        s = lambda *n: (r.normal(size=n) * 0.3).astype(np.float32)
        h = HIDDEN
        self.vocab = vocab
        self.p = {"word": s(len(vocab) + 1, DIM) * 0.2, "chars": s(TRIGRAMS, DIM) * 0.2, "wf": s(DIM, 3 * h), "wb": s(DIM, 3 * h), "bf": np.zeros(3 * h, np.float32), "bb": np.zeros(3 * h, np.float32), "uf": s(h, 3 * h), "ub": s(h, 3 * h), "v": s(2 * h), "w": s(2 * h), "c": np.zeros(1, np.float32)}
        self.p["word"][0] = 0

    def inputs(self, words: list[str]) -> np.ndarray:
        ids = np.array([self.vocab.get(w, 0) for w in words], int)
        grams = [trigrams(w) for w in words]
        sizes = np.array([len(g) for g in grams], int)
        flat = np.array([x for g in grams for x in g], int)
        return self.p["word"][ids] + np.add.reduceat(self.p["chars"][flat], np.cumsum(sizes) - sizes) / sizes[:, None].astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]], 1).astype(np.float32)

    def logits(self, table: np.ndarray, win: np.ndarray) -> np.ndarray:
        """table: projected inputs by word id, row 0 for padding."""
        out = [np.zeros(0, np.float32)]
        for i in range(0, len(win), 4096):
            w = win[i : i + 4096]
            out.append(self._run(table[w], (w > 0).astype(np.float32))[0])
        return np.concatenate(out)

    def _run(self, x, mask, keep=False):
        h3 = 3 * HIDDEN
        f, sf = Gru.forward(x[..., :h3], mask, self.p["uf"], keep)
        b, sb = Gru.forward(x[:, ::-1, h3:], mask[:, ::-1], self.p["ub"], keep)
        both = np.concatenate([f, b[:, ::-1]], 2)
        e = np.where(mask > 0, both @ self.p["v"], np.float32(-1e9))
        a = np.exp(e - e.max(1, keepdims=True)) * np.maximum(mask, 1e-9)
        a /= a.sum(1, keepdims=True)
        pooled = np.einsum("bt,bth->bh", a, both)
        return pooled @ self.p["w"] + self.p["c"][0], (both, a, pooled, sf, sb)

    def step(self, words: "Words", win, y, weight, adam: "Adam") -> float:
        p, h3 = self.p, 3 * HIDDEN
        used, win = np.unique(win, return_inverse=True)
        win = win.reshape(-1, WINDOW)
        xin = words.inputs(p, used)
        pf, pb = xin @ p["wf"] + p["bf"], xin @ p["wb"] + p["bb"]
        mask = (used[win] > 0).astype(np.float32)
        logit, (both, a, pooled, sf, sb) = self._run(np.concatenate([pf, pb], 1)[win], mask, True)
        prob = _sigmoid(logit)
        d = ((prob - y) * weight / len(y)).astype(np.float32)
        g = {"w": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
        dpooled = d[:, None] * p["w"]
        da = np.einsum("bh,bth->bt", dpooled, both)
        de = a * (da - (a * da).sum(1, keepdims=True))
        g["v"] = np.einsum("bt,bth->h", de, both)
        dboth = a[..., None] * dpooled[:, None] + de[..., None] * p["v"]
        dxf, g["uf"] = Gru.backward(dboth[..., :HIDDEN], mask, p["uf"], sf)
        dxb, g["ub"] = Gru.backward(dboth[:, ::-1, HIDDEN:], mask[:, ::-1], p["ub"], sb)
        dx = np.concatenate([dxf, dxb[:, ::-1]], 2).reshape(-1, 2 * h3)
        dp = np.zeros((len(used), 2 * h3), np.float32)
        np.add.at(dp, win.reshape(-1), dx)
        dp[used == 0] = 0
        g["bf"], g["bb"] = dp[:, :h3].sum(0), dp[:, h3:].sum(0)
        g["wf"], g["wb"] = xin.T @ dp[:, :h3], xin.T @ dp[:, h3:]
        words.spread(dp[:, :h3] @ p["wf"].T + dp[:, h3:] @ p["wb"].T, used, p, g)
        adam.apply(p, g)
        p["word"][0] = 0
        return float(-(weight * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).mean())


class Words:
    """The distinct words of the training windows, with their vocabulary ids and trigrams; id 0 pads."""

    def __init__(self, words: list[str], vocab: dict[str, int]):
        grams = [[0], *(trigrams(w) for w in words)]
        self.ids = np.array([0, *(vocab.get(w, 0) for w in words)])
        self.sizes = np.array([len(g) for g in grams])
        self.flat = np.array([x for g in grams for x in g])
        self.begin = np.cumsum(self.sizes) - self.sizes

    def _flat(self, used):
        n = self.sizes[used]
        offset = np.cumsum(n) - n
        return self.flat[np.repeat(self.begin[used] - offset, n) + np.arange(n.sum())], offset, n

    def inputs(self, p, used):
        flat, offset, n = self._flat(used)
        return p["word"][self.ids[used]] + np.add.reduceat(p["chars"][flat], offset) / n[:, None].astype(np.float32)

    def spread(self, dx, used, p, g):
        flat, _, n = self._flat(used)
        g["word"], g["chars"] = np.zeros_like(p["word"]), np.zeros_like(p["chars"])
        np.add.at(g["word"], self.ids[used], dx)
        np.add.at(g["chars"], flat, np.repeat(dx / n[:, None], n, 0))


class Adam:
    def __init__(self, rate: float = 0.01, decay: float = 1e-4):
        self.rate, self.decay, self.n, self.m, self.v = rate, decay, 0, {}, {}

    def apply(self, p, g):
        self.n += 1
        for k, x in g.items():
            x = x + self.decay * p[k]
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * x
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * x * x
            p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.999**self.n)) + 1e-8)).astype(np.float32)


def fit(sample: list[tuple[str, int]], rounds: int = 5, passes: int = 5, seed: int = 11) -> Model | None:
    """Train on (text, label) rows; None unless both classes are there."""
    labels = np.array([y for _, y in sample])
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    texts = [words_of(t) for t, _ in sample]
    pos, neg = Counter(), Counter()
    for ws, y in zip(texts, labels):
        (pos if y else neg).update(set(ws))
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    often = sorted(w for w in pos.keys() | neg.keys() if pos[w] + neg[w] >= 3)
    vocab = {w: i + 1 for i, w in enumerate(often)}
    model = Model(vocab)
    a, b = np.array([pos[w] + 0.5 for w in often], float), np.array([neg[w] + 0.5 for w in often], float)
    odds = (np.log(a / (n1 + 1)) - np.log(b / (n0 + 1))) / np.sqrt(1 / a + 1 / b)
    model.p["word"][1:, 0] = np.clip(odds, -6, 6) / 3
    every = sorted({w for ws in texts for w in ws})
    index = {w: i + 1 for i, w in enumerate(every)}
    words = Words(every, vocab)
    win, doc = windows(np.array([index[w] for ws in texts for w in ws], int), np.array([len(ws) for ws in texts]))
    first = model.p["word"][words.ids, 0]
    scores = first[win].max(1) + 0.01 * first[win].sum(1)
    adam = Adam()
    for k in range(rounds):
        order = np.lexsort((-scores, doc))
        tops = order[np.searchsorted(doc[order], np.arange(len(texts)))]
        keep = tops[labels[doc[tops]] == 1]
        bad = tops[labels[doc[tops]] == 0]
        more = np.flatnonzero(labels[doc] == 0)
        more = rng.choice(more, min(len(more), 2 * len(bad)), replace=False)
        use = np.unique(np.concatenate([keep, bad, more]))
        y = labels[doc[use]].astype(np.float32)
        weight = np.where(y > 0, len(y) / 2 / max(y.sum(), 1), len(y) / 2 / max((1 - y).sum(), 1)).astype(np.float32)
        adam.rate = 0.01 * (1 - 0.7 * k / rounds)
        for _ in range(passes):
            mix = rng.permutation(len(use))
            for i in range(0, len(mix), 256):
                j = mix[i : i + 256]
                model.step(words, win[use[j]], y[j], weight[j], adam)
        table = model.project(words.inputs(model.p, np.arange(len(every) + 1)))
        scores = model.logits(table, win)
    return model


class Scorer:
    """Scores lists of texts with a bounded cache of projected word inputs."""

    def __init__(self, model: Model | None):
        self.model = model
        self._clear()

    def _clear(self):
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1, 6 * HIDDEN), np.float32)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.model is None or not texts:
            return np.zeros(len(texts))
        if len(self.ids) > CACHE_WORDS:
            self._clear()
        split = [words_of(t) for t in texts]
        new = list({w for ws in split for w in ws if w not in self.ids})
        if new:
            self.ids.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, self.model.project(self.model.inputs(new))])
        ids = np.array([i for ws in split for i in map(self.ids.__getitem__, ws)], int)
        win, doc = windows(ids, np.array([len(ws) for ws in split]))
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, doc, self.model.logits(self.table, win))
        return _sigmoid(best)


def score_documents(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with a toxicity column (double, 0 to 1)."""
    name = ensure_unique(docs.columns, ["toxicity"])["toxicity"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, text_col):
                got = scorer([x or "" for x in column(part, text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], [*part.schema.names, name])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def model_for(docs: DataFrame, labels: DataFrame) -> Model | None:
    return fit(training_sample(docs, labels, "toxic", FOLDS, HELD_OUT, PER_CLASS))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = model_for(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
