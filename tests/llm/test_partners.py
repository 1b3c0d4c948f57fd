"""Members of a bucket that go on to be compared by their texts."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa

from rankweave.llm import op09_neardup as nd


def test_a_near_pair_goes_on_from_one_bucket():
    """Every pair within reach is compared in one bucket; each of its members went on from all of its buckets before."""
    by, rng, rows = nd.law(5, 80), np.random.default_rng(3), 60
    sig = np.tile(rng.integers(0, 256, by.parts, dtype=np.uint8), (rows, 1))
    for r in sig:
        r[rng.choice(by.parts, 12, replace=False)] = rng.integers(0, 256, 12)
    keys, members = nd._masks(sig, by), defaultdict(set)
    for r in range(rows):
        for k in keys[r]:
            members[int(k)].add(r)
    merged = {}
    for k in sorted(members):
        if len(members[k]) > 1:
            merged.setdefault(frozenset(members[k]), k)
    went, all_rows = {}, 0
    for m, k in merged.items():
        m = sorted(m)
        ids, zero = pa.array(m, pa.int64()), pa.array([0] * len(m), pa.int64())
        t = pa.table({"key": pa.array([k] * len(m), pa.int64()), "lo": zero, "hi": zero, "own": zero, "rid": ids, "c": ids, "n_shingles": pa.array([100] * len(m), pa.int64()), "sig": pa.array([sig[x].tobytes() for x in m], pa.binary())})
        went[k] = set(nd._partnered(t, by).column("rid").to_pylist())
        all_rows += len(m)
    for a, b in combinations(range(rows), 2):
        if (sig[a] != sig[b]).sum() <= by.reach:
            assert any({a, b} <= w for w in went.values())
    assert sum(map(len, went.values())) < all_rows / 3
