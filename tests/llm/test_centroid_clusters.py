import hashlib

import numpy as np
import pytest

from quillnet.llm import centroid_clusters
from quillnet.llm.common import prepare


def brute(rows, k, rounds, width, scale=1024):
    kept = []
    for key, vec in rows:
        if vec is not None and len(vec) == width and all(v is not None and np.isfinite(v) for v in vec):
            kept.append((key, [int(np.floor(scale * v)) for v in vec]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        placed = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), p in zip(kept, placed) if p == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [nearest(v) for _, v in kept]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    total = sum(d for d, _ in last)
    sums = {j: sum(d for d, p in last if p == j) for j in range(len(centres))}
    return sorted([(key, j, d, sums[j], total, names[j]) for (key, _), (d, j) in zip(kept, last)], key=str)


def result(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, b"x") for r in rows], "vec_id long, embedding array<double>, cluster int, x binary").repartition(3)
    return sorted((tuple(r) for r in centroid_clusters.cluster_vectors(frame, **options).collect()), key=str)


@pytest.mark.parametrize("spread", [0.05, 0.6])
def test_matches_plain_algorithm(spark, spread):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(5, 6))
    rows = [(i, (centres[i % 5] + spread * draw.normal(size=6)).tolist()) for i in range(400)]
    rows += [(9000 + i, rows[0][1]) for i in range(40)]
    assert result(prepare(spark), rows, k=5, rounds=4, width=6) == brute(rows, 5, 4, 6)


def test_edge_cases(spark):
    nan = float("nan")
    rows = [
        (1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (None, [0.5, 0.5]), (None, [-3.0, 0.1]), (4, None), (5, [1.0]), (6, [nan, 0.0]),
        (7, [None, 1.0]), (8, [float("inf"), 0.0]), (9, []), (10, [-0.0001, -7.3]),
    ]
    spark = prepare(spark)
    for k in (1, 3, 20):
        assert result(spark, rows, k=k, rounds=3, width=2) == brute(rows, k, 3, 2)
    assert result(spark, [], k=3, rounds=2, width=2) == []
    assert result(spark, rows[6:7], k=3, rounds=2, width=2) == []
    with pytest.raises(Exception, match="do not fit"):
        result(spark, [(1, [1e30, 0.0])], k=1, rounds=1, width=2)


def test_bounds_save_work_and_stay_exact():
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(8, 16)) * 3000
    x = (centres[draw.integers(0, 8, 3000)] + draw.normal(size=(3000, 16)) * 200).astype(np.int64)
    history = x[:8][None].copy()
    bounds, computed = centroid_clusters.Bounds.unknown(len(x), 8), []
    for _ in range(8):
        computed.append(centroid_clusters.assign(x, bounds, history))
        exact = np.stack([centroid_clusters.distances(x, c) for c in history[-1]], axis=1)
        assert (bounds.cluster == exact.argmin(axis=1)).all()
        new = np.array([x[bounds.cluster == j].sum(axis=0) // max(1, (bounds.cluster == j).sum()) for j in range(8)])
        history = np.concatenate([history, new[None]])
    assert computed[0] == 8 * len(x) and computed[-1] < len(x)
