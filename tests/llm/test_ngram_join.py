import re
from collections import defaultdict

import pytest

from quillnet.llm import ngram_join
from quillnet.llm.common import prepare, table


def shingle_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows):
    sets = {k: shingle_set(text) for k, text in rows}
    owners = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            owners[g].append(k)
    shared = defaultdict(int)
    for keys in owners.values():
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                shared[a, b] += 1
    root = {k: k for k in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_tables_match_brute_force(spark, folder):
    docs = table(prepare(spark), folder, "documents")
    assert result(ngram_join.jaccard_components(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_large_group_of_near_copies_over_many_roots(spark):
    import random

    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(400):
        words = base[: rng.randint(60, 120)]
        words[rng.randrange(len(words))] = f"x{k}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, "only a short common line") for k in range(50)]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    assert result(ngram_join.jaccard_components(docs, node_members=32, fanout=4)) == brute(rows)


def test_edge_cases(spark):
    rows = [
        (5, None), (6, ""), (7, " \t\n"), (8, "One"), (3, "one"), (9, "A b c d e f"), (9, "A b c d e f"), (4, "a B c d e f"),
        (None, "lonely text no id"), (None, "one"), (10, "é" * 3000), (11, "w " * 30_000), (2, "W\n" * 20_000),
    ]
    docs = prepare(spark).createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = sorted(ngram_join.jaccard_components(docs).collect(), key=str)
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in got}
    assert len(got) == len(rows)
    assert found == {
        (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 3), (3, 1, 3), (9, 2, 4), (4, 2, 4), (None, 1, 3), (None, 1, None),
        (10, 1, 10), (11, 1, 2), (2, 1, 2),
    }


def test_any_number_is_an_id(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    other = base.replace("a b c", "1 2 3 4 5 6 7 8 9")
    rows = [(2**62, base), (2**63 - 1, base + " end"), (2**62 + 1, other), (2**63 - 2, other + " end"), (7, other), (-(2**63), "alone in its words"), (2**62 + 5, "lonely")]
    docs = prepare(spark).createDataFrame([*rows, (None, base)], "doc_id long, text string")
    assert result(ngram_join.jaccard_components(docs)) == brute(rows) | {None: (22, 2**62)}


def test_empty_table(spark):
    docs = prepare(spark).createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(docs).count() == 0
