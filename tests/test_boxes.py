"""Contiguous runs against numpy on random pairs of boxes."""

import numpy as np

from tesselar.functions.boxes import with_runs


def runs_of(spark, pairs):
    df = spark.createDataFrame(pairs, "i int, src_offsets array<bigint>, src_shape array<bigint>, tgt_offsets array<bigint>, tgt_shape array<bigint>")
    found = {}
    for r in with_runs(df).collect():
        found.setdefault(r["i"], []).append((r["src_elem"], r["tgt_elem"], r["run_len"]))
    return {k: sorted(v) for k, v in found.items()}


def test_known_runs(spark):
    cases = [
        ([0, 2], [2, 2], [1, 1], [2, 3], [(2, 1, 2)]),
        ([0, 0], [2, 2], [3, 3], [1, 1], []),
        ([0, 0], [4, 4], [1, 2], [2, 2], [(6, 0, 2), (10, 2, 2)]),
        ([2, 1], [2, 2], [0, 0], [4, 4], [(0, 9, 2), (2, 13, 2)]),
        ([0, 0], [2, 4], [0, 0], [2, 4], [(0, 0, 8)]),
        ([1, 1], [1, 1], [1, 1], [1, 1], [(0, 0, 1)]),
        ([1, 1], [3, 2], [2, 0], [2, 3], [(2, 1, 2), (4, 4, 2)]),
        ([0, 1, 0], [2, 2, 3], [1, 0, 1], [2, 3, 2], [(7, 2, 2), (10, 4, 2)]),
        ([0, 4], [2, 4], [0, 0], [2, 8], [(0, 4, 4), (4, 12, 4)]),
        ([0, 0], [4, 2], [0, 1], [4, 1], [(1, 0, 1), (3, 1, 1), (5, 2, 1), (7, 3, 1)]),
        ([], [], [], [], [(0, 0, 1)]),
    ]
    got = runs_of(spark, [(i, *c[:4]) for i, c in enumerate(cases)])
    for i, c in enumerate(cases):
        assert got.get(i, []) == c[4], i


def test_random_boxes(spark):
    rng = np.random.default_rng(5)
    pairs = []
    for i in range(400):
        shape = rng.integers(1, 5, rng.integers(1, 5))
        box = lambda shape=shape: (lo := rng.integers(0, shape), rng.integers(1, shape - lo + 1))
        (so, ss), (to, ts) = box(), box()
        pairs.append((i, so.tolist(), ss.tolist(), to.tolist(), ts.tolist(), shape))
    got = runs_of(spark, [p[:5] for p in pairs])
    for i, so, ss, to, ts, shape in pairs:
        full = np.arange(1, np.prod(shape) + 1).reshape(shape)
        cut = lambda o, s: full[tuple(slice(a, a + b) for a, b in zip(o, s))]
        source, target = cut(so, ss).ravel(), cut(to, ts).ravel()
        made = np.zeros_like(target)
        for s, t, n in got.get(i, []):
            made[t : t + n] = source[s : s + n]
        inside = np.isin(target, source)
        assert np.array_equal(made, np.where(inside, target, 0))
