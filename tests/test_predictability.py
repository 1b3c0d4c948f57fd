"""Out-of-fold AUC against dense fits in NumPy and counted pairs."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from rankweave.operators import predictability as p


def fold(g, k=5):
    return int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % k


def newton(x, y):
    z = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.append(np.ones(x.shape[1]), 0)
    for _ in range(60):
        q = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + np.diag(ridge + 1e-12), z.T @ (q - y) + ridge * w)
    return w


def pairs_auc(score, y):
    wins = [(a > b) + (a == b) / 2 for a, i in zip(score, y) if i for b, j in zip(score, y) if not j]
    return round(sum(wins) / len(wins), 4)


def tfidf(words, train, width):
    tf = np.zeros((len(words), width))
    for i, ws in enumerate(words):
        for w in ws or []:
            tf[i, zlib.crc32(w.encode()) % width] += 1
    df = (tf[train] > 0).sum(0)
    x = tf * np.where(df > 0, np.log((1 + train.sum()) / (1 + df)) + 1, 0)
    return x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-300)


def made(n=400, seed=3):
    rng = random.Random(seed)
    words = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))] for _ in range(n)]
    words[5] = None
    y = [int(rng.random() < (0.7 if "a" in (w or []) else 0.2)) for w in words]
    return [f"g{i % 37}" for i in range(n)], words, y


@pytest.mark.parametrize("parts", [1, 5])
def test_words(spark, parts):
    group, words, y = made()
    rows = spark.createDataFrame(list(zip(group, words, y)), "g string, words array<string>, y int").repartition(parts)
    of = np.array([fold(g) for g in group])
    score = np.zeros(len(y))
    fits = p.hashed_fits(p.counted(rows, "g", "words", "y", width=16).cache(), width=16, tolerance=1e-9)
    for k in range(5):
        x = tfidf(words, of != k, 16)
        w = newton(x[of != k], np.array(y)[of != k])
        assert np.abs(fits.weights[k] - w).max() < 1e-4
        score[of == k] = 1 / (1 + np.exp(-(x[of == k] @ w[:-1] + w[-1])))
    found = p.by_words(rows, "g", "words", "y", width=16).first()
    assert (found["n"], found["n_pos"]) == (len(y), sum(y)) and abs(found["auc"] - pairs_auc(np.round(score, 6), y)) < 2e-3


def test_columns(spark):
    group, words, y = made()
    x = np.array([[len(w or []), float("a" in (w or []))] for w in words])
    rows = spark.createDataFrame([(g, float(a), float(b), c) for g, (a, b), c in zip(group, x.tolist(), y)], "g string, f double, h double, y int")
    of, score = np.array([fold(g) for g in group]), np.zeros(len(y))
    for k in range(5):
        m = of != k
        z = (x - x[m].mean(0)) / x[m].std(0)
        w = newton(z[m], np.array(y)[m])
        score[~m] = 1 / (1 + np.exp(-(z[~m] @ w[:-1] + w[-1])))
    assert p.by_columns(rows, "g", ["f", "h"], "y").first()["auc"] == pairs_auc(np.round(score, 6), y)


def test_one_label_and_none(spark):
    rows = spark.createDataFrame([("a", ["x"], 1), ("b", [], 1), (None, None, 1), ("c", ["x"], None)], "g string, words array<string>, y int")
    assert tuple(p.by_words(rows, "g", "words", "y").first()) == (3, 3, None)
    assert tuple(p.by_words(rows.where("false"), "g", "words", "y").first()) == (0, 0, None)
    assert math.isclose(p.counted_auc(spark.createDataFrame([(0.5, 2, 3), (0.7, 1, 0)], "score double, p long, q long")).first()["auc"], round((2 * 1.5 + 3) / 9, 4))


def test_rows_with_their_number_count_as_often(spark):
    """Rows that look alike are one: the fits' jobs read different rows only (they read every candidate)."""
    from rankweave.operators import learn

    group, words, y = made()
    rows = spark.createDataFrame([(fold(g), float(len(w or [])), c) for g, w, c in zip(group, words, y)], "fold int, f double, y int").cache()
    few = rows.groupBy("fold", "f", "y").count().cache()
    assert few.count() < 70
    want = learn.leave_out(rows, "fold", ["f"], "y", balanced=False)
    got = learn.leave_out(few, "fold", ["f"], "y", balanced=False, times="count")
    assert got.groups == want.groups and np.allclose(got.weights, want.weights, atol=1e-9) and np.allclose(got.intercepts, want.intercepts, atol=1e-9)
