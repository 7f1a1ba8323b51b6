"""Hard negatives against brute force, the curve and the bounds against their definitions."""

import math

import numpy as np
import pytest

from loanloom.llm import hard_negatives as h


def brute(rows):
    v = []
    for vec_id, label, vec in rows:
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        v.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in vec]))
    out = []
    for i, (a, label, vec) in enumerate(v):
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(vec, w)), b, same == label) for j, (b, same, w) in enumerate(v) if j != i)
        for ps, p, _ in [x for x in scored if x[2]][:5]:
            fit = [x for x in scored if not x[2] and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:10]
            out += [(a, p, k + 1, b, -ps, -s) for k, (s, b, _) in enumerate(fit)]
    return sorted(out)


def rows(n, dims, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dims))
    out = []
    for i in range(n):
        label = int(rng.integers(0, 10))
        vec = (centers[label if rng.random() < 0.6 else int(rng.integers(12))] + rng.normal(scale=0.4, size=dims)) / 4
        out.append([i, label, [float(x) for x in vec]])
    for i in range(50, n, 3):
        out[i][2] = out[49][2]  # a very common vector
    out += [[5, 2, out[5][2]], [100, out[100][1], out[100][2]], [None, 1, out[0][2]], [7 * n, None, out[0][2]], [7 * n + 1, 3, None], [7 * n + 2, 3, [float("nan")] * dims], [7 * n + 3, 3, [None] * dims]]
    out += [[7 * n + 4, 3, [float("inf")] + [0.0] * (dims - 1)], [100 * n, 4, [0.0] * dims], [300 * n, 4, [1e3] + [0.0] * (dims - 1)]]
    return out


@pytest.mark.parametrize("block,dims", [(16, 6), (4096, 17)])
def test_same_as_brute_force(spark, block, dims):
    data = rows(420, dims, block)
    frame = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in data], "vec_id long, label int, embedding array<float>, vecs string, a int")
    single = [(a, b, c and [None if x is None else float(np.float32(x)) for x in c]) for a, b, c in data]
    got = sorted(tuple(r) for r in h.hard_negatives(frame, block).collect())
    assert got == brute(single) and len(got) > 100


def test_empty_table(spark):
    assert h.hard_negatives(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (5, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dims, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
    keys = h.hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    walk = cells[np.array(sorted(range(len(cells)), key=keys.__getitem__))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_leave_out_blocks_and_lose_nothing(spark):
    """Of far clusters, a window's blocks are its own; what is left out holds nothing that the window wants."""
    rng = np.random.default_rng(2)
    data = [(i, int(i % 3), [float(x) for x in (np.eye(8)[i * 8 // 800] * 4 + rng.normal(scale=0.05, size=8))]) for i in range(800)]
    frame = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>")
    stored = h.blocks(h.usable(frame), 8, -1024.0, 1280.0, 32)
    own = h.anchors(stored, 8, 32)
    windows = own.selectExpr("a", "0L as r", "label", "200000L as low", f"{1 << 62} as high", "vec")
    need = h.needed(h.grouped(windows, "a div 32"), stored, 8, True)
    read = sum(len(r["a"]) // 8 for r in need.collect())
    assert 8 <= read < own.count() * stored.count()
    assert sorted(tuple(r) for r in h.hard_negatives(frame).collect()) == brute(data)


def test_scores_beyond_the_exact_range_of_doubles():
    a = np.array([[1 << 28, 3, -(1 << 27)]])
    assert h.dot(a, a)[0, 0] == (1 << 56) + 9 + (1 << 54)
