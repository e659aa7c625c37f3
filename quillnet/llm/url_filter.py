"""URL rules by a sorted digest array.

Each rule (host, path) is keyed by the 64-bit xxhash of host + path. Keys are kept sorted in one file
together with the rules' full strings; tasks memory-map it, look the keys of all possible rules of a batch of
URLs up by vectorised binary search, and confirm hits against the stored strings, so a collision never counts.
A rule fits its host and all subdomains when the path starts with the rule's path; the longest rule wins (of
equally long ones that with the longer host). Possible rules of a URL are its host's suffixes, each
with the leading parts of its path whose lengths occur in the rules.

The list is bounded by ``most_rules`` (checked); the file is put into the shared folder and handed to executors
by Spark. Of rules given twice the first counts. Null URLs, and those without ``://``, have empty host
and path and fit no rule. Repeated rows are judged alike; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillnet.llm.common import query, table
from quillnet.session import scratch_path

Rule = tuple[str, str, str]

# Fixed values: (host, path, verdict) of the query.
RULES: tuple[Rule, ...] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def digest(rules: Sequence[Rule]) -> bytes:
    """Counts, sorted keys, string ends, host lengths and verdict numbers, verdict names, strings."""
    first = {}
    for host, path, verdict in rules:
        first.setdefault((host, path), verdict)
    names = sorted(set(first.values()))
    entries = sorted(
        (xxhash.xxh64_intdigest(text := f"{host}\n{path}".encode()), text, len(host.encode()), names.index(verdict))
        for (host, path), verdict in first.items()
    )
    lengths = sorted({len(path) for _, path in first})
    strings = [text for _, text, _, _ in entries]
    head = "\n".join(names).encode()
    body = [
        np.array([len(entries), len(head), len(lengths)], "<u8").tobytes(),
        np.array([e[0] for e in entries], "<u8").tobytes(),
        np.cumsum([len(s) for s in strings], dtype="<u8").astype("<u8").tobytes(),
        np.array([e[2] for e in entries], "<u8").tobytes(),
        np.array([e[3] for e in entries], "<u8").tobytes(),
        np.array(lengths, "<u8").tobytes(),
        head,
        *strings,
    ]
    return b"".join(body)


class Digest:
    """The memory-mapped file."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        count, head, lengths = (int(x) for x in whole[:24].view("<u8"))
        at = 24
        self.keys, self.ends, self.hosts, self.verdicts = (whole[at + 8 * count * k : at + 8 * count * (k + 1)].view("<u8") for k in range(4))
        at += 32 * count
        self.lengths = [int(x) for x in whole[at : at + 8 * lengths].view("<u8")]
        at += 8 * lengths
        self.names = bytes(whole[at : at + head]).decode().split("\n")
        self.strings = whole[at + head :]

    def find(self, texts: Sequence[bytes], hashes: np.ndarray) -> np.ndarray:
        """The place of each text among the rules, or -1."""
        if not len(self.keys) or not len(texts):
            return np.full(len(texts), -1)
        place = np.searchsorted(self.keys, hashes)
        near = np.minimum(place, len(self.keys) - 1)
        found = np.full(len(texts), -1)
        for k in np.flatnonzero((place < len(self.keys)) & (self.keys[near] == hashes)):
            j = int(place[k])
            while j < len(self.keys) and self.keys[j] == hashes[k]:
                start = int(self.ends[j - 1]) if j else 0
                if bytes(self.strings[start : int(self.ends[j])]) == texts[k]:
                    found[k] = j
                    break
                j += 1
        return found


def judge(file: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = Digest(SparkFiles.get(file))
        for frame in frames:
            texts, owner, extent = [], [], []
            for k, (host, path) in enumerate(zip(frame["host"], frame["path"])):
                starts = [0] + [i + 1 for i, c in enumerate(host) if c == "."]
                for start in starts:
                    for length in rules.lengths:
                        if length <= len(path):
                            texts.append(f"{host[start:]}\n{path[:length]}".encode("utf-8", "surrogatepass"))
                            owner.append(k)
                            extent.append((len(host) - start + length, len(host) - start))
            place = rules.find(texts, np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64))
            best: dict[int, tuple] = {}
            for i in np.flatnonzero(place >= 0):
                best[owner[i]] = max(best.get(owner[i], ((-1, -1), "", 0)), (extent[i], texts[i].decode().replace("\n", "", 1), int(place[i])))
            rule = [best[k][1] if k in best else None for k in range(len(frame))]
            verdict = [rules.names[int(rules.verdicts[best[k][2]])] if k in best else None for k in range(len(frame))]
            yield pd.DataFrame({"host": frame["host"], "path": frame["path"], "rule": rule, "verdict": verdict})

    return run


def share(spark: SparkSession, body: bytes) -> str:
    """Writes the file into the shared folder and has Spark hand it to executors; its name there."""
    path = scratch_path(spark, "digest")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(body))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", default: str = "allow", most_rules: int = 5_000_000
) -> DataFrame:
    """``pages`` with host, path, rule (host + path, or null) and verdict (the rule's, else ``default``).

    Host and path are cut by Spark, judged once for each distinct pair and joined back.
    """
    if len(rules) > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    spark = pages.sparkSession
    file = share(spark, digest(rules))
    names = ("host", "path", "rule", "verdict")
    address = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.contains(address, F.lit("://")), F.regexp_replace(address, r"(?s)^.*?://", "")).otherwise("")
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = pages.drop(*names).withColumns(
        {"host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), capitals, small), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}
    )
    judged = cut.select("host", "path").distinct().mapInPandas(judge(file), "host string, path string, rule string, verdict string")
    return cut.join(judged, ["host", "path"], "left").select(
        *[c for c in cut.columns if c not in names], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


ORACLE = f"""
WITH rules(h, p, v) AS (VALUES {', '.join(str(r) for r in RULES)}),
cut AS (SELECT row_number() OVER () AS k, page_id,
  CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM parts JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits USING (k)"""


@query("op3_url_filter", ORACLE)
def url_query(spark, folder):
    judged = filter_urls(table(spark, folder, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")
