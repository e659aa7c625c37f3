import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quillnet.llm import sentence_pieces as sp
from quillnet.llm.common import prepare, table

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
MODEL = sp.pieces(sp.MODEL)
TEXT = st.text(st.sampled_from("aebt  tionhe\n<s>é漢字🙂0x1.A"), max_size=60)


def ids(text):
    return MODEL.encode_plain([" " + text if text else ""])[0].tolist()


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_are_those_of_the_library(text):
    assert ids(text) == LIBRARY.encode(text)
    assert MODEL.decode(ids(text)) == text


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_every_text_comes_back(text):
    assert MODEL.decode(ids(text)) == text


def by_chunks(text, size):
    """The scan, without Spark."""
    frames = list(sp.chunked(size, MODEL.longest)(iter([sp.pd.DataFrame({"key": ["k"], "text": [text]})])))
    chunks = sp.pd.concat(frames)
    states = sp.pd.concat(sp.solve(sp.matrices(sp.MODEL)(iter([chunks]))))
    traced = sp.pd.concat(sp.backtrace(sp.MODEL)(iter([chunks.merge(states, on=["key", "chunk"])])))
    return [k for part in traced.sort_values("chunk")["ids"] for k in part]


@pytest.mark.parametrize("letters", ["ation he", "aaaaab", " ", "tionintheres", "é漢a 🙂", "0123456789abcdef"])
def test_chunks_give_the_same_ids(letters):
    rng = random.Random(len(letters))
    text = "".join(rng.choice(letters) for _ in range(1500))
    for size in (64, 100, 333):
        assert by_chunks(text, size) == ids(text) == LIBRARY.encode(text)


def test_max_plus_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = (np.where(rng.random((4, 4)) < 0.5, -np.inf, rng.integers(-9, 0, (4, 4))) for _ in range(3))
    assert np.array_equal(sp.max_plus(sp.max_plus(a, b), c), sp.max_plus(a, sp.max_plus(b, c)))


def test_table_matches_the_library(spark):
    docs = table(prepare(spark), "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    coded = sp.encode(docs, chunk_chars=4096)
    got = {r.doc_id: (r.ids, r.back) for r in coded.withColumn("back", sp.decoded()(coded["ids"])).collect()}
    assert got == {r.doc_id: (LIBRARY.encode(r.text), r.text) for r in docs.collect()}


def test_letters_without_a_piece_go_by_their_bytes_among_others():
    known = sp.Pieces(sp.MODEL)
    gone = known.letter[ord("t")]
    known.alone[gone], lost = -1, known.id.pop("t")
    assert known.start_together(["ate", "x"]).tolist()[0][:3] == known.start_ids("ate")
    known.id["t"] = lost


def test_segments_whose_hashes_meet_stay_apart(monkeypatch):
    texts = ["the tea", "", "a hat, the tea", "\ud800", "\udc00 the"]
    expected = [MODEL.encode_few([t])[0].tolist() if t else [] for t in texts]
    assert [x.tolist() for x in MODEL.encode_few(texts)] == expected
    monkeypatch.setattr(sp.np, "cumprod", np.zeros_like)
    assert [x.tolist() for x in MODEL.encode_few(texts)] == expected


def test_summaries_of_the_query_are_those_of_the_library(spark):
    docs = table(prepare(spark), "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    for chunk_chars in (256, 32_768):
        got = {r.doc_id: tuple(r.summary) for r in sp.summaries(docs, chunk_chars=chunk_chars).collect()}
        sha = lambda text: hashlib.sha256(np.array(LIBRARY.encode(text or ""), "<i4").tobytes()).hexdigest()
        assert got == {r.doc_id: (len(LIBRARY.encode(r.text or "")), sha(r.text), True) for r in docs.collect()}


def test_edge_cases(spark):
    giant = "no blanks".replace(" ", "") * 300
    rows = [(1, None), (2, ""), (3, " "), (4, giant), (4, giant), (None, "▁ ▁"), (5, "\n\t\r\0 <s></s><unk><0x41>")]
    docs = prepare(spark).createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    got = sp.encode(docs, chunk_chars=256)
    assert got.columns == ["doc_id", "text", "ids"]
    found = sorted(((r.doc_id, r.text, tuple(r.ids)) for r in got.collect()), key=str)
    assert found == sorted(((k, t, tuple(ids(t or ""))) for k, t in rows), key=str)
    assert {r.text: r.back for r in got.withColumn("back", sp.decoded()(got["ids"])).collect() if r.text} == {t: t for _, t in rows if t}
    assert sp.encode(docs.limit(0)).count() == 0
    told = {(r.doc_id, r.text, r.summary.n_tokens, r.summary.round_trip) for r in sp.summaries(docs, chunk_chars=256).collect()}
    assert told == {(k, t, len(ids(t or "")), True) for k, t in rows}
    assert sp.summaries(docs.limit(0)).count() == 0
