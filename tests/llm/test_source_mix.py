import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillnet.llm import source_mix
from quillnet.llm.common import prepare, table

WORD = r"[^\x20\x09-\x0D]+"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 900), st.integers(0, 40)), min_size=1, max_size=8), st.integers(0, 120))
def test_seats_are_the_highest_quotients(parties, seats):
    weights, most = zip(*parties)
    expected = [0] * len(weights)
    for _ in range(min(seats, sum(most))):
        best = max((k for k in range(len(weights)) if expected[k] < most[k]), key=lambda k: (weights[k] / (2 * expected[k] + 1), -k))
        expected[best] += 1
    got = source_mix.sainte_lague(np.array(weights), seats, np.array(most))
    assert got.sum() == sum(expected) and (got <= np.array(most)).all()
    # Equal quotients may be seated in another order, never lower ones.
    lowest = lambda s: sorted(weights[k] / (2 * i + 1) for k in range(len(weights)) for i in range(s[k]))
    assert np.allclose(lowest(got), lowest(expected))


def test_targets_stop_at_three_times_the_size():
    assert source_mix.capped_targets(np.array([10, 990]), np.array([3, 1]), 3).tolist() == [30.0, 970.0]
    assert source_mix.capped_targets(np.array([100, 100, 100]), np.array([1, 2, 3]), 3).tolist() == [50.0, 100.0, 150.0]


def test_mix_of_the_table(spark):
    docs = table(prepare(spark), "/root/testdata/sf0.01", "documents")
    rows = source_mix.mix(docs, shard_words=3000).collect()
    sizes = {r.doc_id: len(re.findall(WORD, r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == sizes
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.taken == r.passes * r["size"] + sum(r.parts[1::2]) - sum(r.parts[::2])
        taken[r.source] += r.taken
        target[r.source] = r.target
    for source, words in taken.items():
        assert abs(words - target[source]) <= 0.03 * target[source]
    again = source_mix.mix(docs.repartition(7), shard_words=3000).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_documents_of_the_mix(spark):
    docs = table(prepare(spark), "/root/testdata/sf0.001", "documents")
    taken = {r.doc_id: r.taken for r in source_mix.mix(docs).collect()}
    words = defaultdict(int)
    for r in source_mix.mixed_documents(docs).collect():
        words[r.doc_id] += len(re.findall(WORD, r.text))
    assert {k: n for k, n in taken.items() if n} == dict(words)


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x " * 50, None), (4, "y z", "b"), (4, "y z", "b"), (None, "q " * 9000, "a"), (5, "w", "")]
    docs = prepare(spark).createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, size int")
    got = source_mix.mix(docs).collect()
    assert sorted((r.doc_id or 0, r["size"], r.source_size) for r in got) == [
        (0, 9000, 9000), (1, 0, 9000), (2, 0, 9000), (3, 50, 50), (4, 2, 4), (4, 2, 4), (5, 1, 1),
    ]
    target = {r.source: r.target for r in got}
    assert target[""] == 3 and target["b"] == 12 and target[None] == 150 and abs(target["a"] - 8890) < 1e-6
    assert {r.source: r.taken for r in got if r.source in ("", None)} == {"": 3, None: 150}
    assert source_mix.mix(docs.limit(0)).count() == 0
    assert source_mix.mixed_documents(docs).columns == docs.columns
