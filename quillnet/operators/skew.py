"""Building blocks for groups of any size.

No function here gathers a group in one task: ranks come from bucket totals plus a rank
inside buckets of bounded size, and pairs of a group come from a grid of bounded cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillnet.session import cut_lineage

CELL_MEMBERS = 2048


def _ranged(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows range-partitioned by ``columns`` and written, with the number of their range as ``_part``.

    Ranges hold about equal numbers of rows, however sparse or uneven the values are.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, *columns).withColumn("_part", F.spark_partition_id()))


def _before(totals: DataFrame, group: Sequence[str], total: str, name: str) -> DataFrame:
    """Running totals of a group's ranges: at most one row per range and group."""
    order = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*group, "_part", F.coalesce(F.sum(total).over(order), F.lit(0)).alias(name))


def ordered_index(df: DataFrame, group: Sequence[str], member: str, name: str, start: int = 0) -> DataFrame:
    """Position of a distinct ``member`` inside its group, by value.

    Rows are cut into ranges of (group, member); a window ranks the rows of one range and group, and
    offsets come from one row per range and group.
    """
    group = list(group)
    rows = _ranged(df, [*group, member])
    totals = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    inside = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(member))
    return (
        rows.withColumn("_inside", inside)
        .join(_before(totals, group, "_n", "_offset"), [*group, "_part"])
        .withColumn(name, F.col("_offset") + F.col("_inside") - 1 + start)
        .drop("_part", "_inside", "_offset")
    )


def quantiles(df: DataFrame, group: Sequence[str], value: str, fractions: Sequence[float], name: str = "at") -> DataFrame:
    """Exact interpolated quantiles of each group as an array, for groups of any size; nulls are left out.

    Values are counted, counts are summed over ranges of (group, value), and only the values around each
    quantile are kept: two rows per fraction and group.
    """
    group = list(group)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v"))
    rows = _ranged(counts.agg(F.count(F.lit(1)).alias("_n")), [*group, "_v"])
    totals = rows.groupBy(*group, "_part").agg(F.sum("_n").alias("_n"))
    sizes = totals.groupBy(*group).agg(F.sum("_n").alias("_size"))
    order = Window.partitionBy(*group, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    placed = placed.join(_before(totals, group, "_n", "_offset"), [*group, "_part"])
    placed = placed.join(sizes, group) if group else placed.withColumn("_size", F.lit(sizes.first()["_size"] or 0))
    first = F.col("_offset") + F.col("_inside")
    spots = F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(float(f)) * (F.col("_size") - 1)).alias("spot")) for k, f in enumerate(fractions)])
    inside = lambda spot: (spot >= F.col("_first")) & (spot < F.col("_first") + F.col("_n"))
    near = placed.withColumn("_first", first).select(*group, "_v", "_n", "_first", F.explode(spots).alias("_s"))
    low, high = F.floor("_s.spot"), F.ceil("_s.spot")
    near = near.filter(inside(low) | inside(high))
    picked = near.groupBy(*group, F.col("_s.k").alias("_k")).agg(
        F.max(F.when(inside(low), F.col("_v"))).alias("low"), F.max(F.when(inside(high), F.col("_v"))).alias("high"),
        F.first(F.col("_s.spot") - F.floor("_s.spot")).alias("part"),
    )
    # The same order of operations as a plain interpolated percentile.
    mixed = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high"))
    return picked.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_k", mixed.alias("x")))), lambda e: e["x"]).alias(name)
    )


def time_ranks(df: DataFrame, key: str, timestamp: str, name: str, wanted: DataFrame | None = None) -> DataFrame:
    """``rank()`` by time within ``key`` for keys of any size, one row per (key, instant); with ``wanted`` for its (key, instant) only.

    Edits are first counted per (key, instant); day totals give the rank at the start of a day
    and the instants of one day are ranked among themselves, so a window task sees at most the
    days of one key or the distinct instants of one day.
    """
    if wanted is not None:
        return _wanted_ranks(df, key, timestamp, name, wanted.select(key, timestamp).distinct())
    instants = df.groupBy(key, timestamp).agg(F.count(F.lit(1)).alias("_n"))
    instants = instants.withColumn("_day", F.to_date(timestamp))
    before = lambda window: F.coalesce(
        F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    days = instants.groupBy(key, "_day").agg(F.sum("_n").alias("_n"))
    days = days.select(key, "_day", before(Window.partitionBy(key).orderBy("_day")).alias("_before_day"))
    return (
        instants.withColumn("_before", before(Window.partitionBy(key, "_day").orderBy(timestamp)))
        .join(days, [key, "_day"])
        .select(key, timestamp, (F.col("_before_day") + F.col("_before") + 1).alias(name))
    )


def _wanted_ranks(df: DataFrame, key: str, timestamp: str, name: str, wanted: DataFrame) -> DataFrame:
    """:func:`time_ranks` of few instants: rows are only counted per (key, quarter), and ranked inside the quarters looked for."""
    quarter = F.date_trunc("quarter", timestamp).alias("_t")
    dated, sought = df.select(key, timestamp, quarter), wanted.select(key, timestamp, quarter)
    totals = dated.groupBy(key, "_t").agg(F.count(F.lit(1)).alias("_n"))
    totals = totals.groupBy(key).agg(F.collect_list(F.struct("_t", "_n")).alias("_all"))  # a row per quarter
    # Rows without a time come before all others.
    earlier = F.filter("_all", lambda q: q["_t"].isNull() | (q["_t"] < F.col("_t")))
    before = F.aggregate(earlier, F.lit(0).cast("bigint"), lambda total, q: total + q["_n"]).alias("_before")
    blocks = sought.select(key, "_t").distinct().join(totals, key).select(key, "_t", before)
    instants = dated.repartition(key, "_t").join(blocks, [key, "_t"]).groupBy(key, "_t", timestamp, "_before").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(key, "_t").orderBy(timestamp).rowsBetween(Window.unboundedPreceding, -1)
    ranks = instants.withColumn(name, F.col("_before") + F.coalesce(F.sum("_n").over(order), F.lit(0)) + 1)
    return ranks.join(sought, [key, "_t", timestamp], "left_semi").select(key, timestamp, name)


def priority_head(
    df: DataFrame, group: Sequence[str], priority: str, size: Column, quota: Column, ties: Sequence[str]
) -> DataFrame:
    """The ``quota`` rows of smallest uniform ``priority`` of each group of about ``size`` rows.

    Rows are bucketed by priority into buckets of about CELL_MEMBERS rows; whole buckets below
    the quota are kept as they are and only the bucket the quota falls into is ranked.
    """
    group = list(group)
    rows = df.withColumn("_quota", quota).withColumn(
        "_bucket", F.floor(F.col(priority) * F.ceil(size / F.lit(CELL_MEMBERS)))
    )
    totals = rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = totals.select(*group, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(priority, *ties))
    return (
        rows.withColumn("_inside", inside)
        .join(totals, [*group, "_bucket"])
        .filter(F.col("_before") + F.col("_inside") <= F.col("_quota"))
        .drop("_quota", "_bucket", "_inside", "_before")
    )


def group_pairs(
    members: DataFrame,
    group: Sequence[str],
    member: str,
    cell_members: int = CELL_MEMBERS,
    largest: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Every unordered pair (e1 < e2) of distinct members of each group, with the group columns.

    A group above ``cell_members`` is cut into hash buckets and the pairs are made in a triangle
    of bucket-by-bucket cells, each a join key of its own, so the pairs of one large group are
    spread over many tasks. Smaller groups are a single cell, which is the plain self-join; when
    the caller knows that no group has more than ``largest`` distinct members, it is all there is.
    ``tasks`` fixes the number of tasks that make pairs, which else follows from the bytes of the rows and not from their pairs.
    """
    group = list(group)
    if largest is not None and largest <= cell_members:
        first = members.select(*group, F.col(member).alias("e1"))
        second = members.select(*group, F.col(member).alias("e2"))
        return first.join(second, group).filter(F.col("e1") < F.col("e2")).select(*group, "e1", "e2")
    rows = members.select(*group, member).distinct()
    large = (
        rows.groupBy(*group)
        .agg(F.ceil(F.count(F.lit(1)) / F.lit(cell_members)).cast("int").alias("_cells"))
        .filter(F.col("_cells") > 1)
    )
    rows = rows.join(large, group, "left").withColumn("_cells", F.coalesce("_cells", F.lit(1)))
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64(member), F.col("_cells")).cast("int"))
    left = rows.select(
        *group,
        F.col(member).alias("_a"),
        F.col("_cell").alias("_row"),
        F.explode(F.sequence("_cell", F.col("_cells") - 1)).alias("_col"),
    )
    right = rows.select(
        *group,
        F.col(member).alias("_b"),
        F.explode(F.sequence(F.lit(0), "_cell")).alias("_row"),
        F.col("_cell").alias("_col"),
    )
    if tasks:
        left, right = (side.repartition(tasks, *group, "_row", "_col") for side in (left, right))
    in_order = (F.col("_row") < F.col("_col")) | (F.col("_a") < F.col("_b"))
    return (
        left.join(right, [*group, "_row", "_col"])
        .filter(in_order)
        .select(*group, F.least("_a", "_b").alias("e1"), F.greatest("_a", "_b").alias("e2"))
    )
