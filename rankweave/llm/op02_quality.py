"""Quality classifier: gated-attention multiple-instance learning over the passages of a document.

Every run of PASSAGE words is encoded as a vector (byte classes, word shapes, repetition, hashed words) and
put through a learned layer. A gate of two learned layers, tanh and sigmoid, weighs each passage; the
softmax-weighted sum is scored by a logistic unit. Document labels alone train all layers together.

Defined cases: null and empty texts are one passage without words and get the score that the model gives
it; without labels of both kinds every score is 0.5; repeated rows are scored alike; very long texts are
scored whole, and learned from in TRAIN_PASSAGES drawn passages; an input column named ``score`` is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .labelled import drawn, held_out, sample
from .shared import quoted, table, with_fields

PASSAGE = 64
CLASSES, BINS = 20, 24
#: The training sample: so many documents of each label at most, and so many passages of each of them at most.
TRAIN_EACH, TRAIN_PASSAGES = 2500, 160
KEEP_FROM = 0.7

_CLASS = np.full(256, 19, np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:0xC0], _CLASS[0xC0:] = 0, 1, 2, 3, 4
for _i, _c in enumerate(b" \n.,!?|*#$%&@"):
    _CLASS[_c] = 5 + _i
_HASH = textkit.Hasher(202, lower=False)


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors of some rows, and for each row (and the end) its first passage."""
    starts, ends, first = textkit.spans(data, offsets, textkit.SPACES)
    counts = np.diff(first)
    passages = np.maximum(1, -(-counts // PASSAGE))
    begin = np.concatenate([[0], np.cumsum(passages)])
    n, row = begin[-1], np.repeat(np.arange(len(counts)), counts)
    of = begin[:-1][row] + (np.arange(len(starts)) - first[:-1][row]) // PASSAGE  # the passage of each word
    words = np.bincount(of, minlength=n)
    head = np.flatnonzero(np.diff(of, prepend=-1))  # the first word of each passage that has words
    edge = np.full(n + 1, len(data))
    edge[of[head]] = starts[head]
    edge[begin[:-1]] = offsets[:-1]  # a row's first passage begins where the row does
    classes = np.bincount(np.repeat(np.arange(n), np.diff(edge)) * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    size = np.maximum(classes.sum(1), 1)
    hashes = _HASH.words(data, starts, ends)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    fresh = _distinct(hashes, of, n)
    length = (ends - starts).astype(float)
    many = np.maximum(words, 1)
    mean = np.bincount(of, length, n) / many
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, n) / many - mean**2, 0))
    initial = _CLASS[data[starts]]
    bins = np.bincount(of * BINS + (hashes >> np.uint64(40)).astype(np.int64) % BINS, minlength=n * BINS).reshape(n, BINS)
    stats = [np.log1p(words), np.bincount(of, same, n) / many, fresh / many, mean, spread, np.bincount(of, initial == 1, n) / many, np.bincount(of, _CLASS[data[ends - 1]] >= 7, n) / many, (words > 0).astype(float)]
    return np.hstack([classes / size[:, None], np.array(stats).T, bins / many[:, None]]).astype(np.float32), begin


def _distinct(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How many different words each passage has."""
    order = np.lexsort((hashes, of))
    h, p = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
    return np.bincount(p, new, n)


def forward(model: dict, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Document scores, and what the gradient needs."""
    z = (x - model["mean"]) / model["std"]
    h = np.tanh(z @ model["W"] + model["b"])
    t, s = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    gate = (t * s) @ model["w"]
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    a = np.exp(gate - np.maximum.reduceat(gate, begin[:-1])[row])
    a /= np.add.reduceat(a, begin[:-1])[row]
    pooled = np.add.reduceat(a[:, None] * h, begin[:-1])
    return _sigmoid(pooled @ model["c"] + model["d"]), (z, h, t, s, a, pooled, row)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gradient(model: dict, kept: tuple, begin: np.ndarray, error: np.ndarray) -> dict:
    """Of the summed log loss; error: score minus label of each document."""
    z, h, t, s, a, pooled, row = kept
    g = {"c": pooled.T @ error, "d": error.sum()}
    dh = a[:, None] * (error[:, None] * model["c"])[row]
    da = (h @ model["c"]) * error[row]
    dgate = a * (da - np.add.reduceat(a * da, begin[:-1])[row])
    g["w"] = (t * s).T @ dgate
    dt, ds = dgate[:, None] * model["w"] * s * (1 - t * t), dgate[:, None] * model["w"] * t * s * (1 - s)
    g["V"], g["U"] = h.T @ dt, h.T @ ds
    dh += dt @ model["V"].T + ds @ model["U"].T
    dz = dh * (1 - h * h)
    return g | {"W": z.T @ dz, "b": dz.sum(0)}


def fit(x: np.ndarray, begin: np.ndarray, y: np.ndarray, hidden: int = 24, gates: int = 8, epochs: int = 25, decay: float = 1e-4) -> dict | None:
    """Train by Adam on documents given as runs of passages; None without both labels."""
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(7)
    d = x.shape[1]
    model = {"mean": x.mean(0), "std": x.std(0) + 0.02}
    layers = {"W": rng.normal(0, d**-0.5, (d, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gates)), "U": rng.normal(0, hidden**-0.5, (hidden, gates)), "w": rng.normal(0, gates**-0.5, gates), "c": np.zeros(hidden), "d": np.float32(0)}
    model |= {k: np.asarray(v, np.float32) for k, v in layers.items()}
    m, v, step = {k: 0.0 for k in layers}, {k: 0.0 for k in layers}, 0
    sizes = np.diff(begin)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 64):
            rows = order[lo : lo + 64]
            own = np.concatenate([[0], np.cumsum(sizes[rows])])
            at = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in rows])
            p, kept = forward(model, x[at], own)
            g, step = gradient(model, kept, own, (p - y[rows]).astype(np.float32)), step + 1
            for k in layers:
                gk = g[k] / len(rows) + decay * model[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * gk, 0.999 * v[k] + 0.001 * gk * gk
                model[k] = (model[k] - 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def passages(column, orders: list[int]) -> list[bytes]:
    """The vectors of each text's passages, or of TRAIN_PASSAGES drawn ones of a longer text."""
    out = []
    for lo, hi, data, offsets in textkit.slices(column):
        x, begin = encode(data, offsets)
        for r in range(hi - lo):
            own = x[begin[r] : begin[r + 1]]
            out.append(own[drawn(len(own), TRAIN_PASSAGES, orders[lo + r])].tobytes())
    return out


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A model from a bounded sample of the labels that aren't held out."""

    rows = sample(docs, labels, "quality", ~held_out(4, 2), TRAIN_EACH, passages)
    if not rows:
        return None
    width = CLASSES + 8 + BINS
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, width) for r in rows]
    return fit(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.array([r["label"] for r in rows], np.float32))


def scores(model: dict | None, column) -> np.ndarray:
    """One score for each text of an Arrow column."""
    out = np.full(len(column), 0.5)
    if model is not None:
        for lo, hi, data, offsets in textkit.slices(column):
            out[lo:hi] = forward(model, *encode(data, offsets))[0]
    return out


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with ``score`` in place of ``text`` (and of a column of that name)."""
    kept = [c for c in docs.columns if c.lower() not in ("text", "score")]

    def scored(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores(model, b.column(len(kept))))], names=[*kept, "score"])

    rows = docs.select(*(quoted(c) for c in kept), "text")
    return rows.mapInArrow(scored, with_fields(rows.drop("text"), "score double"))


def accepted(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of docs, all columns, that the model scores KEEP_FROM or more. Without a model all rows stay."""

    def kept(batches):
        for b in batches:
            yield b if model is None else b.filter(pa.array(scores(model, b.column(b.schema.get_field_index("text"))) >= KEEP_FROM))

    return docs.mapInArrow(kept, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
