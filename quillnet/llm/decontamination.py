"""Benchmark decontamination by suffix arrays over the training documents.

The index is a table of shards. Every task numbers the words of its documents, joins them to sequences of bounded
length, each document closed by an end mark of its own, and writes the words, the sequence and its suffix array (prefix doubling; only suffixes
that are still equal are sorted again). A longer document is cut into pieces that overlap by the longest
match asked for, so nothing is lost at a cut. Nothing is shuffled to build the index.

Every suffix of every test item is then searched in every shard, in blocks of items: its range in the suffix array is narrowed
word by word with vectorised binary searches until it is empty, which gives the longest verbatim match and where it is. On the
way the ranges of windows (``window`` consecutive words of an item; an item of fewer words is one window) are
noted. Ranges of one length are equal or disjoint, so all places of all windows are at most the words of the shard, however common a
window is. From them come the spans of words hit in each document and the items they belong to.

Null and empty texts, or texts without a word, are never hit; items without words hit nothing. Repeated rows are documents
of their own; rows of items that share an id are one item with several texts, and an item without an id is listed as an empty
string. Null document ids are carried. Empty tables give no rows, or no hits. Other columns are ignored, or kept by :func:`clean`.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import State, query, table
from quillnet.llm.terms import LOWERED_SQL, LOWERED_TERM, packed, terms, unpacked

WINDOW = 10
# Words of a shard; positions and ranks of 20 bits are sorted as one number.
SHARD_WORDS = 1_000_000
# Words of the items of one block, together.
BLOCK_WORDS = 1_000_000
# Pairs of a document and an item that are held at once.
PAIRS_AT_ONCE = 1_000_000


def order_of(key: np.ndarray, bits: int) -> np.ndarray:
    """Positions in the order of ``key`` (below 2 ** bits); together with the position in one number where it fits."""
    at_bits = max(1, len(key).bit_length())
    if bits + at_bits <= 63:
        return np.sort(key << at_bits | np.arange(len(key))) & ((1 << at_bits) - 1)
    return np.argsort(key, kind="stable")


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of a sequence of numbers from 0 to below 2**30, in order."""
    n = len(ids)
    bits = max(n + 1, int(ids.max(initial=0)) + 2).bit_length()
    rank, depth = ids.astype(np.int64), 1
    slots, suffixes = np.arange(n), np.arange(n)
    sa = suffixes.copy()
    while len(slots):
        # ``rank`` orders by the first ``depth`` words; that of the suffix ``depth`` further on orders the next ones.
        after = np.where(suffixes + depth < n, rank[np.minimum(suffixes + depth, n - 1)] + 1, 0)
        key = rank[suffixes] << bits | after
        order = order_of(key, 2 * bits)
        suffixes, key = suffixes[order], key[order]
        sa[slots] = suffixes
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffixes] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        shared = ~(first & np.concatenate([first[1:], [True]]))
        slots, suffixes = slots[shared], suffixes[shared]
        depth *= 2
    return sa


def build_shards(overlap: int, shard_words: int):
    """Documents (id, present, digest, text) to a row for each, and a row for each shard."""
    names = ["row", "doc_id", "n_words", "digest", "shard", "words", "ids", "sa", "starts", "rows", "offsets"]
    whole = {c: "Int64" for c in ("row", "doc_id", "n_words", "shard")}

    def numbers() -> defaultdict[bytes, int]:
        return defaultdict(itertools.count().__next__)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, serial, document = TaskContext.get().partitionId() << 32, 0, 0
        pieces: list[tuple[int, int, np.ndarray]] = []
        vocabulary, held = numbers(), 0

        def flush() -> pd.DataFrame:
            nonlocal pieces, held, serial
            # Piece p ends in the number p; words follow after all end marks.
            parts = [part for p, (_, _, words) in enumerate(pieces) for part in (words + len(pieces), [p])]
            ids = np.concatenate(parts).astype(np.int64)
            row = dict.fromkeys(names) | {
                "shard": task | serial,
                "words": b"\n".join(vocabulary),
                "ids": packed(ids),
                "sa": packed(suffix_array(ids)),
                "starts": packed(np.cumsum([0] + [len(words) + 1 for _, _, words in pieces[:-1]])),
                "rows": np.array([r for r, _, _ in pieces], "<i8").tobytes(),
                "offsets": packed(np.array([at for _, at, _ in pieces])),
            }
            serial += 1
            pieces, held = [], 0
            return pd.DataFrame([row]).astype(whole)

        for frame in frames:
            first, sizes = document, []
            for text in frame["text"]:
                parts = [np.fromiter(map(vocabulary.__getitem__, part), np.int64, len(part)) for part in terms(text)]
                words = np.concatenate(parts) if parts else np.empty(0, np.int64)
                for at in range(0, len(words), shard_words):
                    pieces.append((task | document, at, words[at : at + shard_words + overlap]))
                    held += len(pieces[-1][2]) + 1
                    if held >= shard_words:
                        yield flush()
                if not pieces:  # all that was numbered is written
                    vocabulary = numbers()
                sizes.append(len(words))
                document += 1
            ids = pd.array(frame["id"], "Int64")
            ids[~frame["present"].to_numpy(bool)] = pd.NA
            rows = {"row": task | np.arange(first, document), "doc_id": ids, "n_words": sizes, "digest": frame["digest"].array}
            yield pd.DataFrame(dict.fromkeys(names) | rows, index=range(len(frame))).astype(whole)
        if pieces:
            yield flush()

    return run


def build_index(docs: DataFrame, overlap: int = WINDOW - 1, key: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> State:
    """Documents and shards of all ``docs`` as one written table; the caller drops it."""
    known = F.col(key).isNotNull()
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), known.alias("present"), F.md5(text).alias("digest"), F.col(text).alias("text")
    )
    schema = """row long, doc_id long, n_words long, digest string,
      shard long, words binary, ids binary, sa binary, starts binary, rows binary, offsets binary"""
    return State(rows.mapInPandas(build_shards(overlap, shard_words), schema), "shards")


class Tests:
    """A block of items: all their words in one sequence, a stop (-1) after each text, and the windows that start in it."""

    def __init__(self, rows: list[tuple[str, list[str]]], window: int):
        place: dict[bytes, int] = {}
        ids, parts, owners, lengths = sorted({i for i, _ in rows}), [], [], []
        number = {name: k for k, name in enumerate(ids)}
        for name, words in rows:
            n = len(words)
            parts.append(np.array([*(place.setdefault(w.encode("utf-8", "surrogatepass"), len(place)) for w in words), -1], np.int64))
            owners.append(np.full(n + 1, number[name], np.int64))
            length = np.zeros(n + 1, np.int64)
            length[: max(1, n - window + 1)] = min(n, window)
            lengths.append(length)
        self.ids, self.words = np.array(ids, object), list(place)
        self.sequence, self.owner, self.length = np.concatenate(parts), np.concatenate(owners), np.concatenate(lengths)
        ends = np.flatnonzero(self.sequence < 0)
        self.place = np.arange(len(self.sequence)) - np.concatenate([[0], ends[:-1] + 1])[np.searchsorted(ends, np.arange(len(self.sequence)))]


def narrowed(ids: np.ndarray, sa: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each range [low, high) whose suffixes have ``wanted`` at ``depth``; ``ids`` end in -1s."""

    def bound(i: np.ndarray, j: np.ndarray, past: np.ndarray) -> np.ndarray:
        i, j = i.copy(), j.copy()
        open_ = np.flatnonzero(i < j)
        while len(open_):
            mid = (i[open_] + j[open_]) >> 1
            right = ids[np.minimum(sa[mid] + depth, len(ids) - 1)] < past[open_]
            i[open_] = np.where(right, mid + 1, i[open_])
            j[open_] = np.where(right, j[open_], mid)
            open_ = open_[i[open_] < j[open_]]
        return i

    first = bound(low, high, wanted)
    return first, bound(first, high, wanted + 1)


def search_shard(tests: Tests, shard: dict) -> tuple[np.ndarray, ...]:
    """(low, high, depth) of the longest match of every suffix, and (low, high) of every window, as ranges of the suffix array."""
    ids, sa = shard["ids"], shard["sa"]
    local = {w: i for i, w in enumerate(shard["words"])}
    found = np.array([local.get(w, -1) for w in tests.words] + [-1], np.int64)
    sequence = np.where(found[tests.sequence] >= 0, found[tests.sequence] + len(shard["starts"]), -1)
    first_words = ids[sa]
    low = np.searchsorted(first_words, sequence, "left")
    high = np.where(sequence >= 0, np.searchsorted(first_words, sequence, "right"), low)
    deep = (high > low).astype(np.int64)
    alive = np.flatnonzero(deep)
    window_low, window_high = np.zeros_like(low), np.zeros_like(low)
    depth = 1
    while len(alive):
        ends = alive[tests.length[alive] == depth]
        window_low[ends], window_high[ends] = low[ends], high[ends]
        alive = alive[sequence[alive + depth] >= 0]  # every text ends in a stop, so this stays inside
        i, j = narrowed(ids, sa, low[alive], high[alive], depth, sequence[alive + depth])
        alive, i, j = alive[j > i], i[j > i], j[j > i]
        low[alive], high[alive] = i, j
        depth += 1
        deep[alive] = depth
    return low, high, deep, window_low, window_high


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of the counts."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def searcher(tests: Tests):
    """Shards to hits: per document its spans and items, and per item its longest match in the shard."""
    names = ["row", "starts", "ends", "items", "item", "item_at", "n_words", "doc_at"]
    whole = {c: "Int64" for c in ("row", "item_at", "n_words", "doc_at")}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for packed_shard in frame.to_dict("records"):
                shard = {c: unpacked(packed_shard[c]) for c in ("ids", "sa", "starts", "offsets")}
                shard["words"] = packed_shard["words"].split(b"\n")
                rows, starts, offsets, sa, n = np.frombuffer(packed_shard["rows"], "<i8"), shard["starts"], shard["offsets"], shard["sa"], len(shard["ids"])
                low, high, deep, window_low, window_high = search_shard(tests, shard)

                # The longest match of each item, the first in the item if there are several.
                order = np.lexsort([np.arange(len(deep)), -deep, tests.owner])
                order = order[np.concatenate([[True], np.diff(tests.owner[order]) > 0])]
                order = order[deep[order] > 0]
                if len(order):
                    place = sa[low[order]]
                    piece = np.searchsorted(starts, place, "right") - 1
                    longest = {
                        "row": rows[piece], "item": tests.ids[tests.owner[order]], "item_at": tests.place[order], "n_words": deep[order],
                        "doc_at": place - starts[piece] + offsets[piece],
                    }
                    yield pd.DataFrame(dict.fromkeys(names) | longest, index=range(len(order))).astype(whole)

                # Equal windows have equal ranges: one number for each range and length.
                hit = np.flatnonzero(window_high > window_low)
                if not len(hit):
                    continue
                kind, at, which = np.unique(window_low[hit] * (n + 1) + tests.length[hit], return_index=True, return_inverse=True)
                lows, counts, lengths = window_low[hit][at], (window_high - window_low)[hit][at], tests.length[hit][at]
                places = sa[np.repeat(lows, counts) + ramp(counts)]
                edges = np.zeros(n + 1, np.int64)
                np.add.at(edges, places, 1)
                np.add.at(edges, places + np.repeat(lengths, counts), -1)
                covered = np.diff(np.concatenate([[0], (np.cumsum(edges) > 0).astype(np.int8)]))
                begin, end = np.flatnonzero(covered > 0), np.flatnonzero(covered < 0)
                span_piece = np.searchsorted(starts, begin, "right") - 1
                shift = offsets[span_piece] - starts[span_piece]
                begin, end = begin + shift, end + shift

                # Distinct (piece, kind), then the items of each kind, a bounded number of pairs at once.
                pairs = np.unique((np.searchsorted(starts, places, "right") - 1) * len(kind) + np.repeat(np.arange(len(kind)), counts))
                pair_piece, pair_kind = np.divmod(pairs, len(kind))
                owners = np.unique(which * len(tests.ids) + tests.owner[hit])
                owner_kind, owner = np.divmod(owners, len(tests.ids))
                first, many = np.searchsorted(owner_kind, np.arange(len(kind))), np.bincount(owner_kind, minlength=len(kind))
                done = np.unique(pair_piece)
                work = np.cumsum(np.bincount(np.searchsorted(done, pair_piece), many[pair_kind], len(done)))
                for part in np.split(np.arange(len(done)), np.searchsorted(work, np.arange(PAIRS_AT_ONCE, int(work[-1]), PAIRS_AT_ONCE))):
                    if not len(part):
                        continue
                    some = slice(np.searchsorted(pair_piece, done[part[0]]), np.searchsorted(pair_piece, done[part[-1]], "right"))
                    n_items = many[pair_kind[some]]
                    listed = owner[np.repeat(first[pair_kind[some]], n_items) + ramp(n_items)]
                    both = np.unique(np.repeat(pair_piece[some], n_items) * len(tests.ids) + listed)
                    both_piece, listed = np.divmod(both, len(tests.ids))
                    cut = lambda values, of: np.split(values, np.searchsorted(of, done[part[1:]]))
                    inside = (span_piece >= done[part[0]]) & (span_piece <= done[part[-1]])
                    hits = {
                        "row": rows[done[part]], "items": [tests.ids[x].tolist() for x in cut(listed, both_piece)],
                        "starts": cut(begin[inside], span_piece[inside]), "ends": cut(end[inside], span_piece[inside]),
                    }
                    yield pd.DataFrame(dict.fromkeys(names) | hits, index=range(len(part))).astype(whole)

    return run


def item_words(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, words) of every item that has a word, ids as strings."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = [[w.decode("utf-8", "surrogatepass") for part in terms(t) for w in part] for t in frame["text"]]
            yield pd.DataFrame({"item": frame["item"], "words": words})

    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")).distinct()
    return rows.mapInPandas(split, "item string, words array<string>").filter(F.size("words") > 0)


class Contamination:
    """What the items hit in the documents; ``drop`` deletes the tables it is read from."""

    def __init__(
        self, docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
        item_text: str = "text", shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS,
    ):
        self.text = text
        asked = State(item_words(items, item_key, item_text), "asked")
        total, longest = asked.df.agg(F.sum(F.size("words")), F.max(F.size("words"))).first()
        self.index = build_index(docs, max(window, longest or 0) - 1, key, text, max(shard_words, longest or 0))
        shards = self.index.df.filter("shard IS NOT NULL").select("words", "ids", "sa", "starts", "rows", "offsets")
        self.found: list[State] = []
        blocks = -(-(total or 0) // block_words)
        schema = "row long, starts array<long>, ends array<long>, items array<string>, item string, item_at long, n_words long, doc_at long"
        for block in range(blocks):
            # About ``block_words`` words: the queries of one block, never the documents.
            rows = asked.df.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block).collect()
            if rows:
                tests = Tests([(row["item"], row["words"]) for row in rows], window)
                self.found.append(State(shards.mapInPandas(searcher(tests), schema), "hits"))
        asked.drop()
        nothing = docs.sparkSession.createDataFrame([], schema)
        self.hits = reduce(DataFrame.unionAll, [s.df for s in self.found], nothing)

    def documents(self) -> DataFrame:
        """(row, doc_id, digest, n_words, n_hit, n_items, items, contaminated) of every document."""
        spans = F.arrays_zip(F.col("starts").alias("a"), F.col("ends").alias("b"))
        merged = self.hits.filter("items IS NOT NULL").groupBy("row").agg(
            F.array_sort(F.flatten(F.collect_list(spans))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )

        def add(state, span):
            a, b = span["a"], span["b"]
            return F.struct(
                F.greatest(state["reach"], b).alias("reach"),
                (state["n"] + F.greatest(F.lit(0).cast("long"), b - F.greatest(a, state["reach"]))).alias("n"),
            )

        zero = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("n"))
        merged = merged.select("row", F.aggregate("spans", zero, add, lambda s: s["n"]).alias("n_hit"), "items")
        docs = self.index.df.filter("shard IS NULL").select("row", "doc_id", "digest", "n_words")
        rows = docs.join(merged, "row", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
        items = F.coalesce("items", F.array().cast("array<string>"))
        return rows.withColumn("items", items).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)

    def longest(self) -> DataFrame:
        """(item, item_at, n_words, doc_id, doc_at): the longest verbatim match of every item over all shards, and where it is (in words)."""
        best = self.hits.filter("item IS NOT NULL").groupBy("item").agg(
            F.max(F.struct("n_words", (-F.col("item_at")).alias("item_at"), (-F.col("row")).alias("row"), (-F.col("doc_at")).alias("doc_at"))).alias("b")
        )
        best = best.select("item", (-F.col("b.item_at")).alias("item_at"), "b.n_words", (-F.col("b.row")).alias("row"), (-F.col("b.doc_at")).alias("doc_at"))
        docs = self.index.df.filter("shard IS NULL").select("row", "doc_id")
        return best.join(docs, "row").select("item", "item_at", "n_words", "doc_id", "doc_at")

    def clean(self, docs: DataFrame) -> DataFrame:
        """``docs`` without the contaminated ones; a verdict only depends on the text, so equal texts go together."""
        bad = self.documents().filter("contaminated").select(F.col("digest").alias("_digest")).distinct()
        return docs.join(bad, F.md5(self.text) == F.col("_digest"), "left_anti")

    def drop(self) -> None:
        for state in [self.index, *self.found]:
            state.drop()


def report(found: Contamination) -> DataFrame:
    """One row per document, with the digest of its items."""
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.documents().select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


REPORT_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED_SQL.format("coalesce(text, '')")}, '{LOWERED_TERM}') AS w FROM documents),
item AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({LOWERED_SQL.format("coalesce(text, '')")}, '{LOWERED_TERM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS k, array_to_string(w[p:p + least(len(w), {WINDOW}) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS p FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
pos AS (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k),
hit AS (SELECT r, p, k, item FROM (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS gram FROM pos) JOIN win USING (k, gram)),
words AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hit) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN named USING (r)"""


@query("op12_decontamination", REPORT_SQL)
def decontamination_query(spark, folder):
    found = Contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return report(found)
