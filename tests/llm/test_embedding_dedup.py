import numpy as np
import pytest

from quillnet.llm import embedding_dedup
from quillnet.llm.common import prepare, table


def brute(rows, threshold=0.95):
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    ids = np.array([k for k, _ in rows])
    root = ids.copy()
    while True:
        newer = np.array([min([root[i], *root[near[i]]]) for i in range(len(ids))])
        if (newer == root).all():
            break
        root = newer
    return {k: (int(near[i].sum()), int(root[i]), k == root[i]) for i, k in enumerate(ids)}


def result(frame):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in frame.collect()}


@pytest.mark.parametrize("tile_rows", [4096, 64])
def test_table_matches_brute_force(spark, tile_rows):
    vectors = table(prepare(spark), "/root/testdata/sf0.01", "embeddings")
    got = result(embedding_dedup.near_duplicates(vectors, tile_rows=tile_rows))
    assert got == brute([(r.vec_id, r.embedding) for r in vectors.collect()])


def test_dense_groups_over_tiles(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 40))
    rows = [(k, (centres[k % 6] + 0.22 * rng.normal(size=40)).tolist()) for k in range(600)]
    rows += [(1000 + k, rows[0][1]) for k in range(30)]
    got = result(embedding_dedup.near_duplicates(prepare(spark).createDataFrame(rows, "vec_id long, embedding array<double>"), tile_rows=50, slab=8))
    assert got == brute(rows)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0]), (3, [2.0, 0.0]), (9, None), (8, []), (7, [0.0, 0.0]), (6, [1.0, nan]), (4, [inf, 1.0]), (2, [None, 1.0]),
        (1, [-1.0, 0.0]), (1, [-1.0, 0.0]), (None, [0.0, 1.0]), (10, [5.0]), (11, [1e200, 1.0]),
    ]
    frame = prepare(spark).createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, node long")
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(frame).collect()), key=str)
    expected = [
        (5, 3, 3, False), (3, 3, 3, True), (10, 3, 3, False), (11, 3, 3, False), (1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True),
        *[(k, 0, k, True) for k in (9, 8, 7, 6, 4, 2)],
    ]
    assert got == sorted(expected, key=str)


def test_any_number_is_an_id(spark):
    rows = [(2**62, [1.0, 0.0]), (2**63 - 1, [1.0, 0.01]), (-(2**63), [0.0, 1.0]), (2**62 + 3, [0.01, 1.0]), (2**63 - 2, [-1.0, 0.0])]
    frame = prepare(spark).createDataFrame([*rows, (None, [1.0, 0.02]), (None, [0.0, -1.0])], "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(frame).collect()), key=str)
    expected = [
        (2**62, 2, 2**62, True), (2**63 - 1, 2, 2**62, False), (None, 2, 2**62, False), (None, 0, None, True),
        (-(2**63), 1, -(2**63), True), (2**62 + 3, 1, -(2**63), False), (2**63 - 2, 0, 2**63 - 2, True),
    ]
    assert got == sorted(expected, key=str)


def test_nothing_usable(spark):
    frame = prepare(spark).createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert result(embedding_dedup.near_duplicates(frame)) == {1: (0, 1, True)}
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0
