"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The words of a source, laid end to end, are cut into blocks of ``block_words``, or of a ``least_blocks``-th of all
words where that is less, so that a small corpus is not all rounding. All blocks of the mix are
allotted to sources by the highest quotients weight / (2 seats + 1), at most ``most_passes`` times a source's own
blocks; a source's seats are allotted the same way to its shards by their sizes. A shard then takes whole
passes over its line and, for the rest, blocks drawn by its seed. What a document gives is the
part of its place on the line that chosen blocks cover, so no document exceeds ``most_passes`` times its size.

Shards are cut by a seeded hash of the row, about ``shard_words`` each, so a source of any size is spread over
tasks; a shard's documents are laid by the same hash. Only one row per source reaches the driver (at most
``most_sources``, checked); shards of a source are allotted in one task, one row per shard.

Null texts and texts without words have size 0 and give nothing. A null source is a source of its own, last
in the order. Repeated rows are documents of their own; rows equal in id and text are laid side by side, and
which of them gives its words does not matter. An empty table gives no rows. Other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import SPACE, State, by_group, query, table


def sainte_lague(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients weight / (2 k + 1), at most ``most`` each; ties go to the earlier place.

    A common divisor gives all seats but the last few, which are then given one by one.
    """
    weights, most = np.asarray(weights, float), np.asarray(most, np.int64)
    seats = int(min(seats, most[weights > 0].sum()))
    at = lambda divisor: np.where(weights > 0, np.minimum(most, np.floor(weights / divisor + 0.5)), 0).astype(np.int64)
    if seats <= 0:
        return np.zeros(len(weights), np.int64)
    low, high = weights[weights > 0].min() / (2 * seats + 2) / 2, 4 * weights.max()
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if at(middle).sum() > seats else (low, middle)
    got = at(high)
    while got.sum() < seats:
        quotient = np.where(got < most, weights / (2 * got + 1), -1.0)
        got[int(np.argmax(quotient))] += 1
    return got


def capped_targets(sizes: np.ndarray, weights: np.ndarray, passes: float) -> np.ndarray:
    """Shares of the total by weight, none above ``passes`` times its size; the excess is shared again by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    limit, target, free = passes * sizes, np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while free.any():
        rest = sizes.sum() - limit[~free].sum()
        target[free] = rest * weights[free] / weights[free].sum()
        over = free & (target > limit)
        if not over.any():
            break
        target[over] = limit[over]
        free &= ~over
    return target


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def allot(block_words: int, most_passes: int):
    """Per source: its seats to its shards."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(frames, "place"):
            group = group.sort_values("shard")
            blocks = -(-group["words"].to_numpy() // block_words)
            seats = sainte_lague(group["words"].to_numpy(), int(group["seats"].iat[0]), most_passes * blocks)
            yield pd.DataFrame({"place": group["place"], "shard": group["shard"], "quota": seats})

    return run


def chosen_runs(words: int, quota: int, block_words: int, seed: Sequence[int]) -> tuple[int, np.ndarray]:
    """Whole passes, and for the rest the running number of chosen words at each block border."""
    blocks = -(-words // block_words)
    passes, rest = divmod(quota, blocks)
    drawn = np.zeros(blocks, np.int64)
    drawn[np.random.default_rng(list(seed)).permutation(blocks)[:rest]] = 1
    border = np.minimum(np.arange(blocks + 1) * block_words, words)
    return passes, np.append(0, np.cumsum(drawn * np.diff(border)))


def select_blocks(block_words: int, seed: int):
    """Per shard: the words each document gives (``passes`` of all, then the ranges ``parts`` of its words)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(frames, "line"):
            group = group.sort_values(["spot", "row"])
            size = group["size"].to_numpy()
            words, quota = int(size.sum()), int(group["quota"].iat[0])
            if not words:
                yield group.assign(passes=0, parts=[[] for _ in size], taken=0).drop(columns=["line", "spot", "quota"])
                continue
            passes, chosen = chosen_runs(words, quota, block_words, (seed, int(group["place"].iat[0]), int(group["shard"].iat[0])))
            picked = np.diff(chosen) > 0
            end = np.cumsum(size)
            parts, taken = [], []
            for start, stop in zip(end - size, end):
                runs: list[int] = []
                for block in range(int(start // block_words), int(-(-stop // block_words))):
                    if picked[block]:
                        a, b = max(start, block * block_words) - start, min(stop, (block + 1) * block_words) - start
                        if runs and runs[-1] == a:
                            runs[-1] = int(b)
                        else:
                            runs += [int(a), int(b)]
                parts.append(runs)
                taken.append(int(passes * (stop - start) + sum(runs[1::2]) - sum(runs[::2])))
            yield group.assign(passes=passes, parts=parts, taken=taken).drop(columns=["line", "spot", "quota"])

    return run


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    most_passes: int = 3,
    block_words: int = 64,
    shard_words: int = 1_000_000,
    seed: int = 7,
    most_sources: int = 100_000,
    least_blocks: int = 1_000,
) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, passes, parts, taken) of every row of ``docs``.

    Sources by code point, null last, weigh ``weights`` in turn. ``row`` is a hash of id and text.
    """
    spark = docs.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(F.col(key), F.col(text)).alias("row"),
    )
    sized = State(rows, "sizes")
    totals = sized.df.groupBy("source").agg(F.sum("size").alias("words"))
    found = totals.limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = np.array([r["words"] for r in found], np.int64)
    block_words = max(1, min(block_words, int(sizes.sum()) // least_blocks))
    weight = np.array([weights[k % len(weights)] for k in range(len(found))], float)
    target = capped_targets(sizes, weight, most_passes) if len(found) else np.zeros(0)
    blocks = -(-sizes // block_words)
    seats = most_passes * blocks  # sources at their limit give all their passes; the rest is apportioned
    free = target < most_passes * sizes
    if free.any():
        seats[free] = sainte_lague(target[free], round(target[free].sum() / block_words), seats[free])
    plan = spark.createDataFrame(
        [(r["source"], k, int(sizes[k]), float(target[k]), int(seats[k]), int(max(1, -(-sizes[k] // shard_words)))) for k, r in enumerate(found)],
        "source string, place long, source_size long, target double, seats long, shards long",
    )
    planned = sized.df.join(plan, sized.df["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    spot = F.xxhash64("row", F.lit(seed))
    planned = planned.withColumn("spot", spot).withColumn("shard", F.pmod(F.xxhash64("spot"), F.col("shards")))
    shards = planned.groupBy("place", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats"))
    quotas = shards.repartition("place").sortWithinPartitions("place").mapInPandas(
        allot(block_words, most_passes), "place long, shard long, quota long"
    )
    line = F.xxhash64("place", "shard")
    ready = planned.join(quotas, ["place", "shard"]).select(
        "row", "doc_id", "source", "size", "source_size", "target", "place", "shard", "spot", "quota", line.alias("line")
    )
    shape = (
        "row long, doc_id long, source string, size long, source_size long, target double, place long, shard long, "
        "passes long, parts array<long>, taken long"
    )
    lines = ready.repartition(count, "line").sortWithinPartitions("line", "spot", "row")
    return lines.mapInPandas(nullable_ids(select_blocks(block_words, seed)), shape)


def nullable_ids(run):
    """Ids stay integers when some are null."""

    def wrapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(frame.astype({"doc_id": "Int64"}) for frame in frames)

    return wrapped


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_text(text: str, parts: Sequence[int]) -> str:
    """The given ranges of words of a text, with the separators between them as they were."""
    spans = [m.span() for m in WORD.finditer(text)]
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in zip(parts[::2], parts[1::2]))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: one row per whole pass and one for the drawn parts.

    Rows equal in id and text share one decision each; they are numbered on both sides, in any order.
    """
    from pyspark.sql import Window

    taken = mix(docs, key=key, text=text, **options).filter("taken > 0")
    taken = taken.select("row", "passes", "parts", "taken")
    alike = lambda frame: frame.withColumn("_n", F.row_number().over(Window.partitionBy("_row").orderBy("_row")))
    left = alike(docs.withColumn("_row", F.xxhash64(F.col(key), F.col(text))))
    right = alike(taken.withColumnRenamed("row", "_row"))
    joined = left.join(right, ["_row", "_n"])
    cut = F.pandas_udf(lambda texts, parts: pd.Series([cut_text(t, p) for t, p in zip(texts, parts)], dtype=object), "string")
    whole = joined.filter("passes > 0").withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int"))))
    part = joined.filter("size(parts) > 0").withColumn(text, cut(F.col(text), F.col("parts")))
    return whole.select(*docs.columns).union(part.select(*docs.columns))


@query("op2_source_mix")
def mix_query(spark, folder):
    mixed = mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "parts")
