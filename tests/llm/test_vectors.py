"""Clustering and hard negatives against brute force: ties, repeats, nulls, empty tables, clashing columns."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from banstream.llm import hard_negatives as module
from banstream.llm.centroids import Marks, cluster_vectors, intervals, sure
from banstream.llm.hard_negatives import bounds, coarser, hard_negatives, summaries
from banstream.llm.shared import materialize

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance string, ids int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 9, "x", 1) for i, v, label in rows], SCHEMA).repartition(3)


def vectors(draw, n, dims, labels=3):
    """Some in clusters, some equal, some at random, and those that are left out."""
    centers = [[draw.uniform(-1, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        near = draw.choice([*centers, None])
        v = [draw.gauss(0, 0.3) + (near[d] if near else 0) for d in range(dims)]
        rows.append((i * 5, v, draw.randrange(labels)))
    rows += [(7000 + i, rows[3][1], rows[3][2]) for i in range(6)]
    bad = [None, [], [1.0] * (dims + 1), [None, *[0.5] * (dims - 1)], [math.nan, *[0.5] * (dims - 1)], [*[0.5] * (dims - 1), math.inf]]
    rows += [(8000 + 50 * i, v, 1) for i, v in enumerate(bad)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def lloyd(rows, dims, k, rounds, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and good(v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    assign = lambda: [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        c = [[sum(x) // len(members) for x in zip(*members, strict=True)] if (members := [v for (_, v), o in zip(kept, own, strict=True) if o == j]) else c[j] for j in range(len(c))]
    out = [(i, j, far(v, c[j]), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, v), j in zip(kept, assign(), strict=True)]
    per = {j: sum(o[2] for o in out if o[1] == j) for j in range(len(c))}
    return sorted((i, j, d, per[j], sum(per.values()), h) for i, j, d, h in out)


@pytest.mark.parametrize(("dims", "bits", "k"), [(6, 8, 5), (7, 4, 3), (5, 2, 8), (3, 1, 1)])
def test_clusters(spark, dims, bits, k):
    rows = vectors(random.Random(dims), 120, dims)
    got = cluster_vectors(frame(spark, rows), dims=dims, k=k, rounds=6, scale=64, bits=bits).collect()
    assert sorted(map(tuple, got)) == lloyd(rows, dims, k, 6, 64, 3)


def test_clusters_of_few_vectors_and_none(spark):
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [-1.0, 0.0], 0), (None, [4.0, 4.0], 0)]
    got = cluster_vectors(frame(spark, rows), dims=2).collect()
    assert len(got) == 4 and {r["distance"] for r in got} == {0} and {r["vec_id"] for r in got} == {1, 2, None}
    assert cluster_vectors(frame(spark, rows).where(F.lit(False)), dims=2).count() == 0
    with pytest.raises(Exception, match="beyond"):
        cluster_vectors(frame(spark, [(1, [1e30, 0.0], 0)]), dims=2).collect()


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_intervals_hold_the_distances(bits):
    draw = np.random.default_rng(bits)
    x, c = draw.integers(-900, 900, (400, 9)), draw.integers(-900, 900, (7, 9))
    x[0] = 10**6  # far beyond all marks
    marks = Marks(x[1:].mean(axis=0), x[1:].std(axis=0), x.min(axis=0), x.max(axis=0), bits)
    low, high = intervals(marks.pack(x), marks.tables(c))
    exact = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    reduced = exact - (x * x).sum(axis=1)[:, None]
    assert (low <= reduced).all() and (reduced <= high).all()
    told = sure(low, high)
    assert (exact.argmin(axis=1)[told >= 0] == told[told >= 0]).all() and ((told >= 0).mean() > 0.5 or bits < 8)


def test_bounds_hold_the_scores():
    draw = np.random.default_rng(1)
    for dims in (1, 5, 32, 64, 70):
        a, b = draw.integers(-300, 300, (40, dims)), draw.integers(-300, 300, (50, dims))
        exact, width = a @ b.T, np.inf
        for level in module.SEGMENTS:
            one, other = (coarser(*summaries(x, module.SEGMENTS[-1]), level) if level < module.SEGMENTS[-1] else summaries(x, level) for x in (a, b))
            low, high = bounds(one, other)
            assert (low <= exact).all() and (exact <= high).all()
            assert (high - low).mean() <= width + 1e-6
            width = (high - low).mean()


def mined(rows, anchors, scale=16, positives=5, negatives=3):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if i is not None and label is not None and good(v)]
    one = {}
    for i, label, v in kept:
        if anchors(i):
            one[i] = min(one.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in one.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, k) for i, k, w in kept if i != a and len(w) == len(v))
        for s, i, _ in [x for x in scored if x[2] == label][:positives]:
            hard = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(a, i, rank, n, -s, -t) for rank, (t, n, _) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "anchors", "group", "dims"), [(1024, 256, 64, 8), (16, 7, 2, 8), (5, 3, 1, 33)])
def test_hard_negatives(spark, monkeypatch, block, anchors, group, dims):
    for name, value in (("BLOCK", block), ("ANCHORS", anchors), ("GROUP", group)):
        monkeypatch.setattr(module, name, value)
    rows = vectors(random.Random(dims + block), 150, dims)
    rows += [(20, [0.25] * dims, 2), (20, [0.25] * dims, 1), (21, [0.0] * dims, 1), (25, [0.0] * dims, 1), (None, [0.5] * dims, 1), (9000, [0.5] * dims, None)]
    rows += [(10_000 + i, rows[5][1], 2 if i % 3 else 0) for i in range(60)]  # one vector over and over
    got = sorted(map(tuple, hard_negatives(frame(spark, rows), F.col("id") % 10 == 0, scale=16).collect()))
    want = mined(rows, lambda i: i % 10 == 0)
    assert got == want and len(want) > 100


def test_hard_negatives_of_none(spark):
    rows = [(10, [1.0, 0.0], 1), (20, [0.0, 1.0], 2)]
    assert hard_negatives(frame(spark, rows), F.col("id") % 10 == 0).count() == 0  # no positives
    assert hard_negatives(frame(spark, rows).where(F.lit(False)), F.col("id") % 10 == 0).count() == 0


def test_copies_of_anchors_are_not_broadcast(spark):
    """Spark judges copied blocks by the size of one copy: so many, small on disk, were broadcast through the driver."""
    block = spark.createDataFrame([(2, bytes(8), bytes(8), bytes(8))], "dims int, vectors binary, ids binary, labels binary")
    anchors, rows = (materialize(block, name) for name in ("anchors", "rows"))
    pairs = module._pairs(anchors, rows.withColumn("g", F.lit(7)), 64)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert pairs.count() == 1


def test_copies_of_anchors_stay_few():
    assert [module.group_count(n, 200) for n in (0, 1, 10, 624, 64 * 64, 64 * 100)] == [1, 1, 10, 64, 64, 100]


def test_best_scores_are_remembered():
    best = np.full((3, 2), module.NONE)
    module._remember(best, np.array([0, 2, 2]), np.array([5, -4, 9]))
    module._remember(best, np.array([0, 2]), np.array([7, 1]))
    assert best.tolist() == [[7, 5], [module.NONE, module.NONE], [9, 1]]
