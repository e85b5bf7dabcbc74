"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams and of itself (hashed to ``BUCKETS`` rows), so
a misspelling no training text holds still shares most of its vectors with the word it stands for. The
words of a window are averaged and a linear softmax scores the average; embeddings and softmax are
trained jointly in numpy, starting from vectors whose first number is the shrunken log odds of their bucket
(a random start memorises the rare words of the sample instead). One offensive word in a long text would vanish in the average of all its words,
so the windows of a text are pooled by a soft maximum, in training as in scoring.

Training reads a bounded sample of labelled rows (``SAMPLE`` per class by hash order, texts up to
``SAMPLE_CHARS``); every whole text is scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marquesina.llm.common import MEMO, crc_mod, map_texts, raw_texts, table

BUCKETS = 1 << 16
LAST_BUCKET = BUCKETS - 1
SIZE = 8
GRAMS = (3, 4, 5)
WINDOW = 4
STRIDE = 2
SAMPLE = 2_000
SAMPLE_CHARS = 60_000
BATCH = 48
STEPS = 90
RATE = 0.01
SHARPNESS = 8.0
PRIOR = 4.0
SEED = 7

_STRIP = b".,;:!?\"'()[]{}<>|*&%$#"
_FOLD = bytes.maketrans(b"0134578@$", b"oieastbas")


def features(word: bytes) -> list[int]:
    """Buckets of a word: itself and its character n-grams between word marks."""
    w = word.lower().strip(_STRIP).translate(_FOLD)
    if not w:
        return [0]
    # Two bytes a character, so that runs of characters are slices.
    marked = f"<{w.decode('utf-8', 'replace')}>".encode("utf-16-le")
    size, crc = len(marked), zlib.crc32
    out = [crc(w, 1) & LAST_BUCKET]
    for n in GRAMS:
        out += [crc(marked[i : i + 2 * n]) & LAST_BUCKET for i in range(0, size - 2 * n + 1, 2)]
    return out


def window_cuts(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the overlapping windows of ``n`` words."""
    starts = np.arange(0, max(1, n - STRIDE), STRIDE)
    return starts, np.minimum(starts + WINDOW, n)


@dataclass
class Model:
    """Per bucket, the difference of the two softmax logits; ``bias`` sets the even odds."""

    gain: list[float]
    bias: float

    def word(self, word: bytes) -> float:
        found = features(word)
        return sum(map(self.gain.__getitem__, found)) / len(found)

    def pooled(self, words: np.ndarray) -> float:
        """Score of a text from the logits of its words."""
        if not len(words):
            z = self.bias
        else:
            total = np.concatenate([[0.0], np.cumsum(words)])
            a, b = window_cuts(len(words))
            z = _soft_max((total[b] - total[a]) / (b - a))[0] + self.bias
        return 1.0 / (1.0 + float(np.exp(-np.clip(z, -30, 30))))


def _soft_max(z: np.ndarray) -> tuple[float, np.ndarray]:
    """Soft maximum of window logits and the share each window has in its gradient."""
    e = np.exp(SHARPNESS * (z - z.max()))
    share = e / e.sum()
    value = float((share * z).sum())
    return value, share * (1 + SHARPNESS * (z - value))


class Bags:
    """Token numbers of training texts and the buckets of each distinct word."""

    def __init__(self, texts: list[bytes]):
        numbers: dict[bytes, int] = {}
        self.texts = [np.array([numbers.setdefault(w, len(numbers)) for w in t.split()], dtype=np.int64) for t in texts]
        found = [features(w) for w in numbers]
        self.sizes = np.array([len(f) for f in found], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.fromiter((x for f in found for x in f), dtype=np.int64, count=int(self.starts[-1]))

    def log_odds(self, y: np.ndarray) -> np.ndarray:
        """Per bucket, the log ratio of the shares of offensive and clean texts that hold it, ``PRIOR`` texts of each added."""
        held = np.zeros((2, BUCKETS))
        for tokens, label in zip(self.texts, y):
            words = np.unique(tokens)
            sizes = self.sizes[words]
            at = np.repeat(self.starts[words] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            held[label, np.unique(self.flat[at])] += 1
        n = np.array([(y == 0).sum(), (y == 1).sum()])
        share = (held + PRIOR * (held.sum(0) / n.sum())) / (n + PRIOR)[:, None]
        return np.where(held.sum(0) > 0, np.log((share[1] + 1e-3) / (share[0] + 1e-3)), 0.0)

    def batch(self, rows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Texts of a batch by local word number, with the buckets, owners and sizes of those words."""
        words, local = np.unique(np.concatenate([self.texts[i] for i in rows]), return_inverse=True)
        cuts = np.cumsum([len(self.texts[i]) for i in rows])[:-1]
        sizes = self.sizes[words]
        at = np.repeat(self.starts[words] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return np.split(local, cuts), self.flat[at], np.repeat(np.arange(len(words)), sizes), sizes


def train(texts: list[bytes], labels: list[int], steps: int = STEPS, seed: int = SEED) -> Model:
    """Fit embeddings and softmax by Adagrad on balanced batches; the even odds are set on all sampled rows."""
    rng = np.random.default_rng(seed)
    keep = [i for i, t in enumerate(texts) if t.split()]
    y = np.array([labels[i] for i in keep], dtype=np.int64)
    if not len(y) or y.min() == y.max():
        prior = float(np.clip(np.mean(labels) if labels else 0.0, 0.01, 0.99))
        return Model([0.0] * BUCKETS, float(np.log(prior / (1 - prior))))
    bags = Bags([texts[i] for i in keep])
    table_ = rng.normal(0, 0.02, (BUCKETS, SIZE))
    weights = rng.normal(0, 0.1, (SIZE, 2))
    table_[:, 0] = bags.log_odds(y)
    weights[0] = -0.5, 0.5
    bias = np.zeros(2)
    squares = [np.full(x.shape, 1e-3) for x in (table_, weights, bias)]
    sides = [np.flatnonzero(y == k) for k in (0, 1)]
    for _ in range(steps):
        rows = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])
        local, flat, owner, sizes = bags.batch(rows)
        vectors = np.stack([np.bincount(owner, table_[flat, k], len(sizes)) for k in range(SIZE)], axis=1) / sizes[:, None]
        back = np.zeros_like(vectors)
        to_weights, to_bias = np.zeros_like(weights), np.zeros(2)
        for tokens, label in zip(local, y[rows]):
            a, b = window_cuts(len(tokens))
            total = np.concatenate([np.zeros((1, SIZE)), np.cumsum(vectors[tokens], axis=0)])
            mean = (total[b] - total[a]) / (b - a)[:, None]
            z = mean @ weights
            value, share = _soft_max(z[:, 1] - z[:, 0])
            p = 1 / (1 + np.exp(-np.clip(value + bias[1] - bias[0], -30, 30)))
            error = (p - label) * share
            pull = mean.T @ error
            to_weights += np.stack([-pull, pull], axis=1)
            to_bias += np.array([label - p, p - label])
            per = np.outer(error / (b - a), weights[:, 1] - weights[:, 0])
            steps_ = np.zeros((len(tokens) + 1, SIZE))
            np.add.at(steps_, a, per)
            np.add.at(steps_, b, -per)
            spread = np.cumsum(steps_, axis=0)[:-1]
            for k in range(SIZE):
                back[:, k] += np.bincount(tokens, spread[:, k], len(sizes))
        share = (back / sizes[:, None])[owner] / BATCH
        used, slot = np.unique(flat, return_inverse=True)
        grad = np.stack([np.bincount(slot, share[:, k], len(used)) for k in range(SIZE)], axis=1)
        squares[0][used] += grad * grad
        table_[used] -= RATE * grad / np.sqrt(squares[0][used])
        for value, g, s in ((weights, to_weights / BATCH, squares[1]), (bias, to_bias / BATCH, squares[2])):
            s += g * g
            value -= RATE * g / np.sqrt(s)
    model = Model((table_ @ (weights[:, 1] - weights[:, 0])).tolist(), 0.0)
    z = np.array([_logit(model.pooled(_words(model, t))) for t in (texts[i] for i in keep)])
    model.bias = -_even(z, y)
    return model


def _words(model: Model, text: bytes) -> np.ndarray:
    memo: dict[bytes, float] = {}
    return np.array([memo[w] if w in memo else memo.setdefault(w, model.word(w)) for w in text.split()])


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _even(z: np.ndarray, y: np.ndarray) -> float:
    """Cut with the fewest errors per class; of a range of such cuts the middle."""
    order = np.argsort(z)
    missed = np.concatenate([[0], np.cumsum(y[order] == 1)]) / max(1, (y == 1).sum())
    alarms = np.concatenate([[(y == 0).sum()], (y == 0).sum() - np.cumsum(y[order] == 0)]) / max(1, (y == 0).sum())
    best = np.flatnonzero(np.isclose(missed + alarms, (missed + alarms).min()))
    at = int(best[len(best) // 2])
    edges = np.concatenate([[z[order[0]] - 1], z[order], [z[order[-1]] + 1]])
    return float((edges[at] + edges[at + 1]) / 2)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[list[bytes], list[int]]:
    """At most ``per_class`` labelled texts of each class, the first in order of a hash of their id.

    Rows whose crc32 of the id modulo 5 is 0 are held out. Rows without a label, id or text are not learned.
    """
    chosen = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(crc_mod(F.col("doc_id"), 5) != 0).select("doc_id", "toxic").distinct()
    parts = [chosen.filter(f"toxic = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    texts = docs.select("doc_id", "text").filter(F.length("text").between(1, SAMPLE_CHARS))
    rows = parts[0].unionByName(parts[1]).join(texts, "doc_id").collect()
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    return [r[2].encode() for r in rows], [int(r[1]) for r in rows]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every text; a null or blank text scores as the bias alone. Repeated rows get a row each."""

    def make():
        memo: dict[bytes, float] = {}

        class Known(dict):
            def __missing__(self, word: bytes) -> float:
                if len(self) > 2 * MEMO:
                    self.clear()
                value = self[word] = model.word(word)
                return value

        known = Known(memo)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in raw_texts(batch):
                words = text.split()
                out.append(model.pooled(np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=len(words))))
            return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, pa.float64())], ["doc_id", "score"])

        return work

    return map_texts(docs, ["doc_id", "text"], make, "doc_id long, score double")


def op2_toxicity_scores(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = train(*sample(docs, table(spark, folder, "labels")))
    return score(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
