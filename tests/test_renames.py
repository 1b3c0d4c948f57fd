"""Renames against one greedy walk over all pairs."""

import random
import zlib
from collections import Counter

from rankweave.operators import renames as r


def base(p):
    return p.rsplit("/", 1)[-1]


def weights(text):
    out = Counter()
    for x in text.split("\n"):
        out[x] += len(x.encode()) + 1
    return out


def walked(files, least):
    """{(old, new): similarity} of one change set."""
    sides = {s: {p: x for q, p, x in files if q == s and p and x} for s in ("removed", "added")}
    found = {}
    for key in (lambda p, x: (x, base(p)), lambda p, x: x):
        for k in {key(p, x) for p, x in sides["removed"].items()}:
            order = lambda p: (zlib.crc32(p.encode()) % r.RANGES, p)
            old, new = (sorted((p for p, x in sides[s].items() if key(p, x) == k), key=order) for s in ("removed", "added"))
            for a, b in zip(old, new):
                found[a, b] = 100
                del sides["removed"][a], sides["added"][b]
    edges = []
    for a, x in sides["removed"].items():
        for b, y in sides["added"].items():
            u, v = weights(x), weights(y)
            s = 100 * sum(min(w, v[k]) for k, w in u.items()) // max(sum(u.values()), sum(v.values()))
            if s >= least:
                edges.append((-s, base(a) != base(b), a, b))
    for s, _, a, b in sorted(edges):
        if all(a != x and b != y for x, y in found):
            found[a, b] = -s
    return found


def test_renames(spark):
    rng = random.Random(8)
    rows = []
    for c in range(12):
        texts = ["\n".join(rng.choice(["", "import os", "return x", *[f"line {i} é" for i in range(9)]]) for _ in range(rng.randint(1, 12))) for _ in range(5)]
        for side in ("removed", "added"):
            for i in range(rng.choice([1, 4, 14])):
                x = rng.choice(texts).split("\n")
                if rng.random() < 0.7:
                    x[rng.randrange(len(x))] = f"new {rng.randrange(4)}"
                rows.append((f"c{c}", side, f"{side[0]}{i % 3}/{'same' if i % 4 else side}{i % 5}_{i}.py", "\n".join(x)))
    rows += [("c0", "removed", "e.py", ""), ("c0", "added", "f.py", ""), ("c0", "removed", "n.py", None), ("c0", "added", None, "line 1"), (None, "added", "z.py", "q"), (None, "removed", "y.py", "q"), ("c1", "kept", "k.py", "x")]
    long = "\n".join(f"l{i}" for i in range(20_000))
    rows += [("big", "removed", "a.py", long), ("big", "added", "b.py", long + "\nmore"), ("big", "added", "c.py", "l1\n" * 30_000), ("big", "added", "b.py", long + "\nmore")]
    rows += [("copies", s, f"{s}{i}.py", "same\ntext") for s, n in (("removed", 150), ("added", 90)) for i in range(n)]
    table = spark.createDataFrame(rows, "commit string, side string, path string, text string").repartition(6)
    for least in (50, 80):
        found = {}
        for x in r.renames(table, ["commit"], least).collect():
            assert (x["old"], x["new"]) not in found.setdefault(x["commit"], {})
            found[x["commit"]][x["old"], x["new"]] = x["similarity"]
        for c in {x[0] for x in rows if x[0]}:
            assert found.get(c, {}) == walked([x[1:] for x in rows if x[0] == c], least), (c, least)
        assert None not in found


def test_nothing(spark):
    assert r.renames(spark.createDataFrame([], "commit string, side string, path string, text string"), ["commit"]).count() == 0
