import re

import numpy as np
import xxhash

from quillnet.llm import url_filter
from quillnet.llm.common import prepare


def brute(url, rules=url_filter.RULES):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?q=/de/", "https://example.org/en/17#t", "http://example.org/en/2", "x://org",
    "http://org/", "http://notexample.org/es/", "http://b.com/de/", "http://b.com/fr", "http://com/fr/1", "http://a?b/c", "a://b://c/d", "http://\nx.org/\n",
    "http://x.com/" + "de/" * 9000, "http://É.org/",
]


def test_rules_and_edge_cases(spark):
    rows = [(k, url, "clash") for k, url in enumerate(URLS)] + [(0, None, "clash"), (None, URLS[4], "clash")]
    pages = prepare(spark).createDataFrame(rows, "page_id long, url string, rule string")
    got = url_filter.filter_urls(pages).collect()
    expected = [(k, *brute(url)) for k, url, _ in rows]
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(expected, key=str)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_many_rules_and_no_rules(spark):
    rules = [(f"h{k}.net", f"/p{j}", "block" if k % 2 else "allow") for k in range(300) for j in range(5)]
    urls = [f"http://a.h{k}.net/p{k % 7}x" for k in range(320)]
    pages = prepare(spark).createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {k: brute(url, rules) for k, url in enumerate(urls)}
    assert {r.rule for r in url_filter.filter_urls(pages, []).collect()} == {None}


def test_colliding_keys_are_told_apart(tmp_path):
    file = tmp_path / "digest"
    file.write_bytes(url_filter.digest([("a", "/", "block")]))
    rules = url_filter.Digest(str(file))
    key = np.array([xxhash.xxh64_intdigest(b"a\n/")], np.uint64)
    assert rules.find([b"a\n/"], key).tolist() == [0]
    assert rules.find([b"b\n/"], key).tolist() == [-1]
