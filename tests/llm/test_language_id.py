import numpy as np

from quillnet.llm import language_id
from quillnet.llm.catalogue import QUERIES
from quillnet.llm.common import prepare, table


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    known = {r.doc_id: r.lang for r in table(prepare(spark), folder, "documents").collect()}
    got = QUERIES["op6_language_id"](spark, folder).collect()
    assert {r.doc_id for r in got} == set(known) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert 0.1 * len(got) < len(held) < 0.3 * len(got)
    assert np.mean([r.lang_pred == known[r.doc_id] for r in held]) > 0.97


def test_slices_count_like_whole_texts(monkeypatch):
    text = "Ça alors, 12 fois! straße.. ΟΔΟΣ Σ İI   " * 20 + " .. " * 30 + "a b"
    for longest in (1, 3, 5):
        monkeypatch.setattr(language_id, "SLICE", 200_000)
        whole = language_id.counted(text, 512, longest)
        for size in (1, 2, 3, 10, 37):
            monkeypatch.setattr(language_id, "SLICE", size)
            assert np.array_equal(language_id.counted(text, 512, longest), whole)


def test_edge_cases(spark):
    rows = [(1, "aaa bbb", "xx"), (2, "ccc ddd", "yy"), (3, None, "xx"), (4, "12 !?", "xx"), (5, "", None), (6, "bab aab", None), (6, "bab aab", None), (None, "cdc dcd " * 90_000, None)]
    docs = prepare(spark).createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    model = language_id.fit(docs)
    got = sorted(((r.doc_id, r.lang_pred) for r in language_id.predict(docs, model, "doc_id").collect()), key=str)
    expected = [(1, "xx"), (2, "yy"), (3, "und"), (4, "und"), (5, "und"), (6, "xx"), (6, "xx"), (None, "yy")]
    assert got == sorted(expected, key=str)
    nothing = language_id.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, nothing, "doc_id").collect()} == {("und", 0.0)}
    assert language_id.predict(docs.limit(0), model, "doc_id").count() == 0
