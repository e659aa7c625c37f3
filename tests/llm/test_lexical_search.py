import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillnet.llm import lexical_search
from quillnet.llm.common import prepare
from quillnet.llm.terms import packed, terms, unpacked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def brute(docs, items, k=10):
    counts = [(i, Counter(split(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counts if c)
    n_terms = sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for i, c in counts:
            if not c:
                continue
            m = 10 + (90 * c.total() * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(split(text)) if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if gone else i, -s) for r, (s, gone, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def result(spark, docs, items, building=None, **searching):
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, rank int, term string").repartition(3)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, item int")
    index = lexical_search.build_index(frame, **(building or {}))
    got = sorted((tuple(r) for r in lexical_search.search(index.df, asked, **searching).collect()), key=str)
    index.drop()
    return got


def corpus(n=900, seed=4):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(draw.choices(words, weights, k=draw.randint(0, 60)))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(60)]  # ties
    items = [(i, " ".join(draw.choices(words, weights, k=draw.randint(1, 25)))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize(
    "sizes",
    [{}, {"building": {"segment_documents": 150}, "run": 8, "block_terms": 40}, {"building": {"segment_postings": 300}, "short": 0.4, "run": 16}],
)
def test_matches_brute_force(spark, sizes):
    docs, items = corpus()
    assert result(prepare(spark), docs, items, **sizes) == brute(docs, items)


def test_edge_cases(spark):
    docs = [
        (5, "Alpha beta"), (5, "alpha beta"), (None, "alpha  BETA"), (2, "ALPHA-beta"), (3, None), (4, ""), (6, " .,- "), (7, "Äpfel äpfel é"),
        (8, "gamma " * 300_000), (-1, "alpha beta"),
    ]
    items = [(1, "alpha beta"), (1, "alpha beta"), (1, "Äpfel"), (2, None), (3, ""), (4, "äpfel zeta"), (None, "gamma gamma"), (9, "zeta")]
    expected = brute(docs, items)
    assert result(prepare(spark), docs, items) == expected
    assert [r[2] for r in expected if r[0] == 1 and r[1] <= 5][:1] and (None, 1, 8) in [r[:3] for r in expected]


def test_nothing(spark):
    spark = prepare(spark)
    assert result(spark, [], [(1, "a")]) == []
    assert result(spark, [(1, "a")], []) == []
    assert result(spark, [(1, None)], [(1, "a")]) == []


def test_long_texts_are_split_whole(monkeypatch):
    monkeypatch.setattr("quillnet.llm.terms.SLICE", 7)
    text = "Ab cd, " * 50 + "x" * 40 + " end é"
    assert [w.decode() for part in terms(text) for w in part] == split(text)


def test_packing():
    for values in ([], [0], [255, 256], [70_000, 1], [2**40, 3]):
        assert unpacked(packed(np.array(values, np.int64))).tolist() == values
