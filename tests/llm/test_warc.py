import gzip
import hashlib
import io

from quillnet.llm import warc
from quillnet.llm.catalogue import QUERIES
from quillnet.llm.common import prepare, table


def expected(rows):
    payloads = [(key, (html or "").encode()) for key, _, html in rows]
    top = {}
    for key, body in payloads:
        if len(body) >= 1000 and key is not None:
            top[body] = max(top.get(body, key), key)
    out = []
    for key, body in payloads:
        refers = top.get(body) if len(body) >= 1000 and top.get(body) != key else None
        out.append((key, len(body), hashlib.sha1(body).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_query_reads_back_every_page(spark):
    rows = [tuple(r) for r in table(prepare(spark), "/root/testdata/sf0.01", "pages").select("page_id", "url", "html").collect()]
    assert found(QUERIES["op5_warc"](spark, "/root/testdata/sf0.01")) == expected(rows)


def test_edge_cases_and_small_ranges(spark):
    long, fake = "é" * 600, "\r\n\r\nWARC/1.1\r\n\r\n" * 90
    rows = [
        (1, None, None), (2, "http://a\r\nWARC-Type: x", ""), (3, "u", long), (9, "u", long), (9, "u", long), (None, "u", long), (4, "u", fake), (5, "u", fake),
        (6, "u", "x" * 999), (7, "u", "x" * 999), (None, None, "y" * 2000), (None, None, "y" * 2000), (8, "u", "".join(chr(300 + k % 5000) for k in range(90_000))),
    ]
    pages = prepare(spark).createDataFrame([(*r, b"clash") for r in rows], "page_id long, url string, html string, member binary")
    files = warc.write_archives(pages)
    for split in (1, 100, 1 << 22):
        assert found(warc.read_archives(files, split)) == expected(rows)
    bodies = {r.page_id: r.payload.decode() for r in warc.read_archives(files).filter("record_type = 'response'").collect() if r.page_id}
    assert bodies[8] == rows[-1][2] and bodies[5] == fake
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_a_magic_inside_a_record_is_not_a_record():
    inner = gzip.compress(b"WARX/1.0 not a record")
    record = warc.member("response", 1, "u", hashlib.sha1(inner).hexdigest(), len(inner), inner)
    stored = gzip.compress(gzip.decompress(record), 0)  # kept as they are, the inner bytes show
    whole = stored + record
    assert whole.count(warc.MAGIC) > 2
    for cut in range(1, len(whole)):
        ranges = [list(warc.records(io.BytesIO(whole), a, b)) for a, b in ((0, cut), (cut, len(whole)))]
        assert len(ranges[0]) + len(ranges[1]) == 2
