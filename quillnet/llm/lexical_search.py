"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

The index is a table of segments: every task cuts its documents into segments of bounded size and writes, for
each term of a segment, its sorted documents and frequencies, and for each segment the ids and sizes of its documents. Nothing is shuffled to
build it. Queries run over it in blocks:

1. The postings of a block's terms give the document frequencies and, with the corpus totals, integer weights.
2. In each segment the short lists of a query are taken term by term: their scores are summed into accumulators, sorted by document.
3. The accumulators are then one more list beside the long ones. All have their largest score per run of documents, so
   runs whose bounds do not reach the least score that can still count are skipped. In the other runs the lists of
   largest bound name the candidates, and the remaining lists are probed by binary search, largest bound first, dropping a candidate
   as soon as what is left cannot lift it. Scores held from earlier segments of the task are a threshold for the later ones.

Skips are strict, so ties are all seen: the result is exact, equal scores by ascending id. A task returns at most k rows an item.

Null and empty texts, or texts without a term, match nothing and do not count in the corpus totals. A null document id sorts after all
ids. Repeated rows of documents are documents of their own; rows of items with equal id and text are one item. Empty tables give no
rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillnet.llm.common import State, by_group, query, table
from quillnet.llm.terms import LOWERED_SQL, TERM, packed, terms, unpacked

# A segment is closed at so many postings or documents.
SEGMENT_POSTINGS = 2_000_000
SEGMENT_DOCUMENTS = 60_000
# Distinct terms of all items of one block of queries, together.
BLOCK_TERMS = 200_000
# Documents in a run with one bound per list, and how many runs are first evaluated together.
RUN = 128
RUNS_AT_ONCE = 16
# A list is short in a segment if it holds less than this share of its documents.
SHORT = 1 / 32
HEAD = -1


def build_segments(frames: Iterator[pd.DataFrame], most_postings: int, most_documents: int) -> Iterator[pd.DataFrame]:
    """Documents (id, present, text) to rows of the index; a row without a term describes the documents of its segment."""
    task, serial = TaskContext.get().partitionId(), 0
    names = ["segment", "term", "n", "total", "docs", "freqs", "ids", "present"]

    def fresh():
        return defaultdict(itertools.count().__next__), [], [], [], [], []

    vocabulary, found, freqs, sizes, ids, present = fresh()
    postings = 0

    def flush() -> pd.DataFrame:
        nonlocal vocabulary, found, freqs, sizes, ids, present, postings, serial
        segment = (task << 32) | serial
        serial += 1
        lengths = np.array([len(x) for x in found], np.int64)
        term = np.concatenate(found)
        order = np.argsort(term, kind="stable")
        freq, doc = np.concatenate(freqs)[order], np.repeat(np.arange(len(found)), lengths)[order]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(vocabulary)))])
        rows = [
            (segment, word.decode("utf-8", "surrogatepass"), j - i, 0, packed(doc[i:j]), packed(freq[i:j]), None, None)
            for word, i, j in zip(vocabulary, cuts[:-1].tolist(), cuts[1:].tolist())
        ]
        size = np.array(sizes, np.int64)
        rows.append((
            segment, None, int((size > 0).sum()), int(size.sum()), packed(size), None,
            np.array(ids, "<i8").tobytes(), np.array(present, np.uint8).tobytes(),
        ))
        vocabulary, found, freqs, sizes, ids, present = fresh()
        postings = 0
        return pd.DataFrame(rows, columns=names)

    for frame in frames:
        for key, known, text in zip(frame["id"].to_numpy(), frame["present"].to_numpy(), frame["text"]):
            counts: Counter[bytes] = Counter()
            for words in terms(text):
                counts.update(words)
            found.append(np.fromiter(map(vocabulary.__getitem__, counts), np.int64, len(counts)))
            freqs.append(np.fromiter(counts.values(), np.int64, len(counts)))
            sizes.append(counts.total())
            ids.append(int(key))
            present.append(bool(known))
            postings += len(counts)
            if postings >= most_postings or len(sizes) >= most_documents:
                yield flush()
    if sizes:
        yield flush()


def build_index(
    docs: DataFrame, key: str = "doc_id", text: str = "text", segment_postings: int = SEGMENT_POSTINGS, segment_documents: int = SEGMENT_DOCUMENTS
) -> State:
    """The index of all ``docs`` as a written table; the caller drops it."""
    known = F.col(key).isNotNull()
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), known.alias("present"), F.col(text).alias("text"))
    schema = "segment long, term string, n long, total long, docs binary, freqs binary, ids binary, present binary"
    return State(rows.mapInPandas(lambda frames: build_segments(frames, segment_postings, segment_documents), schema), "lexical")


def item_terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        words = [sorted({w.decode("utf-8", "surrogatepass") for part in terms(t) for w in part}) for t in frame["text"]]
        yield pd.DataFrame({"item": frame["item"], "terms": words})


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted documents of some lists with their summed scores."""
    docs, at = np.unique(np.concatenate([d for d, _ in lists]), return_inverse=True)
    sums = np.zeros(len(docs), np.int64)
    np.add.at(sums, at, np.concatenate([s for _, s in lists]))
    return docs, sums


def run_bounds(docs: np.ndarray, scores: np.ndarray, runs: int, width: int) -> np.ndarray:
    """The largest score of a list in each run of ``width`` documents."""
    top = np.zeros(runs, np.int64)
    run = docs // width
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    top[run[starts]] = np.maximum.reduceat(scores, starts)
    return top


class Best:
    """The k best (score, id) of one item so far."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.unknown = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """A score below this cannot be among the best any more."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        scores = np.concatenate([self.scores, scores])
        ids, unknown = np.concatenate([self.ids, ids]), np.concatenate([self.unknown, unknown])
        order = np.lexsort([ids, unknown, -scores])[: self.k]
        self.scores, self.ids, self.unknown = scores[order], ids[order], unknown[order]


def search_segment(
    lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_docs: int, best: Best, ids: np.ndarray, unknown: np.ndarray, width: int, share: float
) -> None:
    """Adds to ``best`` what one segment holds; ``lists`` are (documents, scores, bounds of runs), one per term of the item."""
    short = [(d, s) for d, s, _ in lists if len(d) < share * n_docs]
    long = [x for x in lists if len(x[0]) >= share * n_docs]
    runs = -(-n_docs // width)
    if short:
        docs, sums = accumulate(short) if len(short) > 1 else short[0]
        long.append((docs, sums, run_bounds(docs, sums, runs, width)))
    long.sort(key=lambda x: -int(x[2].max()))
    bounds = np.array([b for _, _, b in long])
    # rest[i] bounds what the lists from i on can still add in a run.
    rest = np.concatenate([np.cumsum(bounds[::-1], axis=0)[::-1], np.zeros((1, runs), np.int64)])
    todo, at_once = np.arange(runs), RUNS_AT_ONCE
    while True:
        todo = todo[rest[0][todo] >= best.least]
        if not len(todo):
            return
        now, todo = todo[:at_once], todo[at_once:]
        at_once *= 2
        low, high = now * width, (now + 1) * width
        docs, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        for i, (listed, scores, _) in enumerate(long):
            fresh = rest[i][now] >= best.least  # runs in which a document of no earlier list can still count
            if fresh.any():
                first, last = np.searchsorted(listed, low[fresh]), np.searchsorted(listed, high[fresh])
                picked = np.repeat(first - np.concatenate([[0], np.cumsum(last - first)[:-1]]), last - first) + np.arange((last - first).sum())
                held = ~np.isin(docs // width, now[fresh])
                parts = [(docs[~held], sums[~held]), (listed[picked], scores[picked])]
                docs, sums, kept, kept_sums = *accumulate(parts), docs[held], sums[held]
            else:
                kept, kept_sums, docs, sums = docs, sums, docs[:0], sums[:0]
            if len(kept):
                able = kept_sums + rest[i][kept // width] >= best.least
                kept, kept_sums = kept[able], kept_sums[able]
                at = np.minimum(np.searchsorted(listed, kept), len(listed) - 1)
                kept_sums = kept_sums + np.where(listed[at] == kept, scores[at], 0)
            if len(kept):
                docs, sums = np.concatenate([docs, kept]), np.concatenate([sums, kept_sums])
        good = sums >= best.least
        best.add(sums[good], ids[docs[good]], unknown[docs[good]])


def searcher(items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, width: int, share: float):
    """Postings (segment, tid, docs, freqs) of a block, sorted by segment and tid, to the best k of every item in this task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [Best(k) for _ in items]
        for group in by_group(frames, "segment"):
            head = group.iloc[0]
            sizes, ids = unpacked(head["docs"]), np.frombuffer(head["ids"], "<i8")
            unknown = np.frombuffer(head["present"], np.uint8) == 0
            norm = 8 * (10 + (90 * sizes * n_docs) // n_terms)
            runs = -(-len(sizes) // width)
            lists = {}
            for tid, docs, freqs in zip(group["tid"].to_numpy()[1:], group["docs"].iloc[1:], group["freqs"].iloc[1:]):
                if weights[tid] > 0:
                    docs, freqs = unpacked(docs), unpacked(freqs)
                    scores = weights[tid] * ((1_000_000_000 * freqs) // (1000 * freqs + norm[docs]))
                    lists[int(tid)] = docs, scores, run_bounds(docs, scores, runs, width)
            for (_, wanted), held in zip(items, best):
                there = [lists[t] for t in wanted.tolist() if t in lists]
                if there:
                    search_segment(there, len(sizes), held, ids, unknown, width, share)
        rows = [(item, int(s), int(i), bool(u)) for (item, _), b in zip(items, best) for s, i, u in zip(b.scores, b.ids, b.unknown)]
        yield pd.DataFrame(rows, columns=["item", "score", "id", "unknown"])

    return run


def search(
    index: DataFrame, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text", block_terms: int = BLOCK_TERMS, run: int = RUN,
    short: float = SHORT,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for every item, as a written table."""
    spark = items.sparkSession
    shape = "item_id {}, rank int, doc_id long, score long".format(dict(items.dtypes)[key])
    numbered = State(items.select(F.col(key).alias("item_id"), F.col(text).alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    asked = State(numbered.df.select("item", "text").mapInPandas(item_terms, "item long, terms array<string>"), "asked")
    segments, n_docs, n_terms = index.filter("term IS NULL").agg(F.count(F.lit(1)), F.sum("n"), F.sum("total")).first()
    total = asked.df.agg(F.sum(F.size("terms"))).first()[0]
    if not n_docs or not total:
        return spark.createDataFrame([], shape)
    blocks = -(-total // block_terms)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-segments // 4))
    found, written = [], [numbered, asked]
    for block in range(blocks):
        # About ``block_terms`` terms: the queries of one block, never the documents.
        chosen = asked.df.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).filter(F.size("terms") > 0)
        rows = chosen.select("item", "terms").collect()
        words = sorted({w for row in rows for w in row["terms"]})
        place = {w: i for i, w in enumerate(words)}
        wanted = [(row["item"], np.array([place[w] for w in row["terms"]], np.int64)) for row in rows]
        if not words:
            continue
        # Written, so that Spark knows how small it is and does not move the index for the join.
        vocabulary = State(spark.createDataFrame(list(place.items()), "term string, tid long"), "vocabulary")
        listed = index.filter("term IS NOT NULL").join(vocabulary.df, "term").select("segment", "tid", "n", "docs", "freqs")
        postings = State(listed, "postings")
        written += [vocabulary, postings]
        weights = np.zeros(len(words), np.int64)
        for tid, df in postings.df.groupBy("tid").agg(F.sum("n")).collect():
            weights[tid] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        nothing = F.lit(None).cast("binary")
        heads = index.filter("term IS NULL").select("segment", F.lit(HEAD).cast("long").alias("tid"), "docs", nothing.alias("freqs"), "ids", "present")
        lists = postings.df.select("segment", "tid", "docs", "freqs", nothing.alias("ids"), nothing.alias("present"))
        tasks = heads.union(lists).repartition(parts, "segment").sortWithinPartitions("segment", "tid")
        found.append(tasks.mapInPandas(searcher(wanted, weights, n_docs, n_terms, k, run, short), "item long, score long, id long, unknown boolean"))
    rows = reduce(DataFrame.unionAll, found).withColumn("doc_id", F.when(~F.col("unknown"), F.col("id")))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    result = State(ranked.join(numbered.df.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    for state in written:
        state.drop()
    return result.df


SEARCH_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED_SQL.format("coalesce(text, '')")}, '{TERM}') AS t FROM documents),
posting AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
whole AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
item AS (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT DISTINCT i, unnest(regexp_extract_all({LOWERED_SQL.format("coalesce(text, '')")}, '{TERM}')) AS term FROM item),
weighed AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM posting, whole
  WHERE term IN (SELECT term FROM asked) GROUP BY term),
sized AS (SELECT r, doc_id, 100 - 90 + ((90 * len(t) * n_docs) // n_terms) AS m FROM d, whole),
scored AS (SELECT i, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weighed USING (term) JOIN posting USING (term) JOIN sized USING (r) GROUP BY i, r),
ranked AS (SELECT i, r, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked JOIN item USING (i) JOIN d USING (r) WHERE rank <= 10"""


@query("op11_lexical_search", SEARCH_SQL)
def lexical_query(spark, folder):
    index = build_index(table(spark, folder, "documents"))
    found = search(index.df, table(spark, folder, "benchmark"))
    index.drop()
    return found
