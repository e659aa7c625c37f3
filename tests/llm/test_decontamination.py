import hashlib
import random
import re

import numpy as np
import pytest

from quillnet.llm import decontamination
from quillnet.llm.common import prepare

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(words, window):
    return {tuple(words)} if 0 < len(words) < window else {tuple(words[i : i + window]) for i in range(len(words) - window + 1)} if words else set()


def brute(docs, items, window=10):
    owners = {}
    for name, text in items:
        for gram in windows(split(text), window):
            owners.setdefault(gram, set()).add("" if name is None else str(name))
    out = []
    for key, text in docs:
        words, hit, named = split(text), set(), set()
        for size in {len(g) for g in owners}:
            for p in range(len(words) - size + 1):
                found = owners.get(tuple(words[p : p + size]))
                if found:
                    hit |= set(range(p, p + size))
                    named |= found
        out.append((key, len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def longest(docs, items):
    """The length of the longest common run of words of each item."""
    best = {}
    for name, text in items:
        a = split(text)
        for _, other in docs:
            b, row = split(other), {}
            for i in range(len(a)):
                row = {j: row.get(j - 1, 0) + 1 for j in range(len(b)) if a[i] == b[j]}
                if row:
                    best[str(name)] = max(best.get(str(name), 0), *row.values())
    return best


def frames(spark, docs, items):
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, row int, digest string").repartition(3)
    return frame, spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, item int")


def result(spark, docs, items, **options):
    found = decontamination.Contamination(*frames(spark, docs, items), **options)
    got = sorted((tuple(r) for r in decontamination.report(found).collect()), key=str)
    return got, found


def corpus(seed=3):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(draw.choices(words, k=draw.choice([1, 3, 9, 10, 11, 30])))) for i in range(20)]
    docs = []
    for i in range(150):
        body = draw.choices(words, k=draw.randint(0, 50))
        if i % 3 == 0:
            passage = draw.choice(items)[1].split()
            at = draw.randint(0, len(body))
            body[at:at] = passage[: draw.randint(1, len(passage))] if i % 2 else passage
        docs.append((i, " ".join(body)))
    return docs + [(1000 + i, docs[i][1]) for i in range(9)], items


@pytest.mark.parametrize("options", [{}, {"shard_words": 60, "block_words": 30}, {"window": 4, "shard_words": 200}])
def test_matches_brute_force(spark, options):
    docs, items = corpus()
    got, found = result(prepare(spark), docs, items, **options)
    assert got == brute(docs, items, options.get("window", 10))
    assert {r.item: r.n_words for r in found.longest().collect()} == longest(docs, items)
    texts = dict(docs)
    asked = {str(k): split(t) for k, t in items}
    for r in found.longest().collect():
        assert split(texts[r.doc_id])[r.doc_at : r.doc_at + r.n_words] == asked[r.item][r.item_at : r.item_at + r.n_words]
    found.drop()


def test_clean_removes_contaminated_rows(spark):
    docs, items = corpus()
    frame, asked = frames(prepare(spark), docs, items)
    found = decontamination.Contamination(frame, asked)
    kept = found.clean(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(docs, items) if not r[5])
    found.drop()


def test_edge_cases(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    docs = [
        (1, None), (2, ""), (3, " ._- "), (None, passage), (4, passage.upper() + "!"), (4, "x " + passage), (4, passage), (5, "a " * 120_000 + passage + " b" * 9),
        (6, "one Two"), (7, "Ä é two"), (8, passage[: passage.rindex(" ")] + "x"),
    ]
    items = [(10, passage), (9, passage), (9, "one two"), (None, "é two"), (11, None), (12, "..."), (13, "zz"), (14, "b b")]
    spark = prepare(spark)
    assert result(spark, docs, items)[0] == brute(docs, items)
    assert result(spark, docs, items, shard_words=1000)[0] == brute(docs, items)
    assert result(spark, docs, [])[0] == brute(docs, [])
    assert result(spark, [], items)[0] == []


def test_common_window_in_many_documents(spark):
    passage = " ".join(f"p{i}" for i in range(10))
    docs = [(i, f"{passage} d{i} {passage}") for i in range(400)]
    items = [(i, f"{passage} q{i}") for i in range(30)]
    got, _ = result(prepare(spark), docs, items, shard_words=3000)
    assert got == brute(docs, items)


def test_pairs_are_made_in_slices(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PAIRS_AT_ONCE", 7)
    docs, items = corpus(5)
    assert result(prepare(spark), docs, items)[0] == brute(docs, items)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    draw = np.random.default_rng(seed)
    ids = draw.integers(0, [2, 3, 50, 1, 2**28, 7][seed], draw.integers(1, 400))
    ids = np.concatenate([ids, ids[: len(ids) // 2], ids])
    assert decontamination.suffix_array(ids).tolist() == sorted(range(len(ids)), key=lambda i: ids[i:].tolist())
