import re

import duckdb
import sentencepiece

import corpus_pipeline as p
from quillnet.llm import quality, secret_scan, sentence_pieces, source_mix
from quillnet.llm.common import prepare, table
from tests.llm.test_ngram_join import brute

FOLDER = "/root/testdata/sf0.01"


def redacted(text):
    spans = []
    for rank, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(rule.pattern, text, re.I | re.A if rule.any_case else re.A):
            if len(m[rule.group]) >= rule.least:
                spans.append((m.start(), rank, m.end(), rule.kind))
    out, at = [], 0
    for start, _, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_stages_match_brute_force(spark, tmp_path):
    docs = table(prepare(spark), FOLDER, "documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(p.STAGES):
        before = {}
        for r in docs.collect():
            before.setdefault(r.doc_id, []).append(r)
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        rows = after.collect()
        if k < len(p.STAGES) - 1:
            assert after.columns == p.COLUMNS
        if k == 0:
            expected = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.ORACLE}) WHERE kept").fetchall()}
            assert {r.doc_id for r in rows} == expected and len(rows) == len(expected) < len(texts)
        elif k == 1:
            parts = brute([(r[0].doc_id, r[0].text) for r in before.values()])
            assert sorted(r.doc_id for r in rows) == sorted({root for _, root in parts.values()})
        elif k == 2:
            assert {r.doc_id: r.text for r in rows} == {i: redacted(texts[i]) for i in before}
            assert any(r.text != texts[r.doc_id] for r in rows)
        elif k == 3:
            taken = {r.doc_id: r.taken for r in source_mix.mix(docs).collect()}
            words = dict.fromkeys(taken, 0)
            for r in rows:
                words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
            assert words == taken
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
            coded = sorted((r.doc_id, tuple(r.ids)) for r in rows)
            assert coded == sorted((i, tuple(library.encode(r.text))) for i, rs in before.items() for r in rs)
            assert all(r.round_trip for r in rows)
        docs = after


def test_whole_run_and_edge_cases(spark, tmp_path):
    text = "one two three four five six seven eight nine ten eleven token=abcdefgh12345"
    rows = [(1, text, None, "a", 3), (1, text, None, "a", 3), (2, text.upper().lower(), "en", None, 3), (3, None, "en", "b", None), (None, text + " more words here", None, None, 1), (4, "", None, None, 0)]
    docs = prepare(spark).createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, spans int")
    for folder, frame in (("some", docs), ("none", docs.limit(0))):
        frame.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        got = p.run(spark, f"{tmp_path}/{folder}")
        assert {r.doc_id for r in got.collect()} == ({1, None} if folder == "some" else set())


def test_every_text_is_a_document_of_its_own(spark):
    words = lambda mark: " ".join(f"{mark}{k}" for k in range(40))
    texts = [(5, "a"), (5, "b"), (5, "b"), (3, "b"), (5, "c"), (None, "c"), (None, "d"), (None, "d"), (None, "e"), (2**63 - 1, "f"), (2**62, "f"), (-(2**63), "g")]
    rows = [(i, words(mark), "en", "s", 1) for i, mark in texts] + [(None, words("d") + " more", "en", "s", 1), (9, words("g") + " more", "en", "s", 1)]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = p.near_duplicates(spark, docs, "").collect()
    kept = sorted(((r.doc_id, r.text.split()[0][0]) for r in got), key=str)
    assert kept == sorted([(5, "a"), (3, "b"), (5, "c"), (None, "d"), (None, "e"), (2**62, "f"), (-(2**63), "g")], key=str)
    assert p.near_duplicates(spark, docs.limit(0), "").count() == 0
