"""Exact near-duplicate links of embeddings by PCA-ordered tiled comparison.

Directions are rotated to the principal axes of all vectors, so leading coordinates hold most of every
dot product. Vectors are cut into tiles along the first axis; tiles further apart there than any two linked
directions can be are never compared. Inside a pair of tiles the leading coordinates are multiplied first,
and the rest of each product is bounded by the product of suffix norms (Cauchy-Schwarz): the suffix
norm is one more coordinate, so product and bound are one multiplication. Pairs whose bound is below the
threshold stop there; the others go on to the next coordinates. What is left is judged by the
cosine of the vectors as given, in double precision, so rotation errors only cost work.

Equal vectors are one member with its number of copies. The work is that of an exact join: it grows with
the square of the vectors that the first axis cannot separate, in tiles of bounded size; links are counted
in the tiles and only spanning links leave them, at most one per vector and tile pair.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. A shorter vector
counts as padded with zeros. Rows with a null id are counted as neighbours and have no component unless linked
to others; repeated rows are vectors of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import State, by_group, components, query, table

SLACK = 1e-9
ROWS_AT_ONCE = 1024
PAIRS_AT_ONCE = 50_000


def directions(bodies: pd.Series, width: int) -> np.ndarray:
    """Unit vectors from packed doubles; scaled first so that no square overflows."""
    x = np.zeros((len(bodies), width))
    for k, body in enumerate(bodies):
        v = np.frombuffer(body)
        x[k, : len(v)] = v
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        bodies = [np.asarray(v, np.float64).tobytes() for v in frame["vec"]]
        yield pd.DataFrame({"cls": frame["cls"], "least_id": frame["least_id"], "copies": frame["copies"], "vec": bodies})


def moments(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for frame in frames:
            if len(frame):
                x = directions(frame["vec"], width)
                total += x.T @ x
        i, j = np.divmod(np.arange(width * width), width)
        yield pd.DataFrame({"i": i, "j": j, "v": total.ravel()})

    return run


def first_axis(axis: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"at": directions(frame["vec"], len(axis)) @ axis})

    return run


def place(axis: np.ndarray, borders: np.ndarray, reach: float):
    """The tile of each vector and the tiles it has to meet."""
    low, high = np.append(-np.inf, borders), np.append(borders, np.inf)
    first = np.searchsorted(high, low - reach)
    last = np.searchsorted(low, high + reach, side="right") - 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                tile = np.searchsorted(borders, directions(frame["vec"], len(axis)) @ axis, side="right")
                yield frame.assign(tile=tile, first=first[tile], last=last[tile])

    return run


def close_pairs(
    left: np.ndarray, right: np.ndarray, given: np.ndarray, other: np.ndarray, threshold: float, slab: int
) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs with cosine >= threshold; ``left``/``right`` are rotated, ``given``/``other`` as they came."""
    width = left.shape[1]
    suffix = lambda x, k: np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x[:, :k], x[:, :k])) + 1e-12)
    rows, cols = [], []
    for at in range(0, len(left), ROWS_AT_ONCE):
        block = left[at : at + ROWS_AT_ONCE]
        k = min(slab, width)
        bound = np.column_stack([block[:, :k], suffix(block, k)]) @ np.column_stack([right[:, :k], suffix(right, k)]).T
        i, j = np.nonzero(bound >= threshold - SLACK)
        del bound
        for start in range(0, len(i), PAIRS_AT_ONCE):
            a, b = i[start : start + PAIRS_AT_ONCE], j[start : start + PAIRS_AT_ONCE]
            done, partial = 0, np.zeros(len(a))
            for k in range(min(slab, width), width, slab):
                partial = partial + np.einsum("ij,ij->i", block[a, done:k], right[b, done:k])
                done = k
                alive = partial + suffix(block, k)[a] * suffix(right, k)[b] >= threshold - SLACK
                a, b, partial = a[alive], b[alive], partial[alive]
            cosine = np.einsum("ij,ij->i", given[at + a], other[b])
            sure = cosine >= threshold
            rows.append(at + a[sure])
            cols.append(b[sure])
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member reachable) for members that are linked, by label passing inside one task."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def compare(basis: np.ndarray, threshold: float, slab: int):
    """Per pair of tiles: links counted for each member, and spanning links."""
    width = len(basis)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(frames, "pair"):
            tiles = group["tile"].to_numpy()
            node, cls, copies = (group[c].to_numpy() for c in ("node", "cls", "copies"))
            given = directions(group["vec"], width)
            rotated = given @ basis
            cut = int(np.searchsorted(tiles, tiles[-1]))  # sorted by tile: the second tile starts here
            a, b = close_pairs(rotated[:cut] if cut else rotated, rotated[cut:], given[:cut] if cut else given, given[cut:], threshold, slab)
            if cut:
                b = b + cut
            else:
                a, b = a[a < b], b[a < b]
            if not len(a):
                continue
            n = len(group)
            links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
            some = np.flatnonzero(links)
            yield pd.DataFrame({"cls": cls[some], "n": links[some].astype(np.int64), "a": pd.NA, "b": pd.NA}).astype({"a": "Int64", "b": "Int64"})
            moved, root = spanning(a, b, n)
            yield pd.DataFrame({"cls": cls[moved], "n": 0, "a": pd.array(node[moved], "Int64"), "b": pd.array(node[root], "Int64")})

    return run


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    threshold: float = 0.95,
    tile_rows: int = 4096,
    slab: int = 16,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vec = F.col(embedding).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.when(usable, F.transform(vec, lambda x: x + F.lit(0.0))).alias("vec"))
    # A class key of 64 bits is enough to add up links; members are the vectors themselves.
    rows = rows.withColumn("cls", F.xxhash64("vec"))
    distinct = rows.filter("vec IS NOT NULL").groupBy("vec", "cls").agg(
        F.min("vec_id").cast("string").alias("least_id"), F.count(F.lit(1)).alias("copies")
    )
    packed = distinct.mapInPandas(pack, "cls long, least_id string, copies long, vec binary")
    # Members are numbered as the table is written: ids may be any number, repeat or be missing.
    node = F.monotonically_increasing_id().alias("node")
    members = State(packed.select("cls", node, F.col("least_id").cast("long").alias("least_id"), "copies", "vec"), "vectors")
    size, width = members.df.agg(F.count(F.lit(1)), F.max(F.length("vec")) / 8).first()
    if not size:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    width = int(width)
    summed = members.df.select("vec").mapInPandas(moments(width), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    matrix = np.zeros((width, width))
    for i, j, v in summed.collect():  # width * width numbers, whatever the rows
        matrix[i, j] = v
    basis = np.linalg.eigh(matrix)[1][:, ::-1].copy()
    tiles = max(1, -(-size // tile_rows))
    shares = [k / tiles for k in range(1, tiles)]
    along = members.df.select("vec").mapInPandas(first_axis(basis[:, 0]), "at double")
    borders = np.unique(along.approxQuantile("at", shares, 0.25 / tiles)) if shares else np.empty(0)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    placed = members.df.drop("least_id").mapInPandas(
        place(basis[:, 0], borders, reach), "cls long, node long, copies long, vec binary, tile long, first long, last long"
    )
    met = placed.withColumn("partner", F.explode(F.sequence("first", "last"))).withColumn(
        "pair", F.least("tile", "partner") * tiles + F.greatest("tile", "partner")
    )
    tasks = met.drop("first", "last", "partner").repartition(parts, "pair").sortWithinPartitions("pair", "tile")
    found = State(tasks.mapInPandas(compare(basis, threshold, slab), "cls long, n long, a long, b long"), "links")
    linked = components(found.df.filter("a IS NOT NULL").select("a", "b"))
    counts = found.df.filter("n > 0").groupBy("cls").agg(F.sum("n").alias("n"))

    classes = members.df.select("cls", "node", "least_id", "copies").join(counts, "cls", "left").join(linked, "node", "left")
    links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")
    classes = State(classes.select("cls", "least_id", F.coalesce("root", "node").alias("root"), links), "classes").df
    # One row per component; a component without any id has none.
    lowest = classes.groupBy("root").agg(F.min("least_id").alias("lowest"))
    classes = classes.join(lowest, "root").select("cls", "lowest", "n")
    labelled = rows.withColumn("cls", F.when(F.col("vec").isNotNull(), F.col("cls"))).drop("vec").join(classes, "cls", "left")
    component = F.coalesce("lowest", "vec_id").alias("component_id")
    labelled = labelled.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component)
    return labelled.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op9_embedding_dedup")
def embedding_query(spark, folder):
    return near_duplicates(table(spark, folder, "embeddings"))
