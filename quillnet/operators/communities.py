"""Measures and features of communities of contributors and articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillnet.functions import columns as C
from quillnet.operators.projection import both_ways
from quillnet.session import cut_lineage


def community_density(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Directed member edges, members with an edge, and edges over possible pairs.

    Edges leaving the community count too. ``communities`` is (user_id, community_id).
    """
    degrees = both_ways(edges).groupBy("e1").agg(F.count(F.lit(1)).alias("degree"))
    sizes = (
        communities.join(degrees, F.col("user_id") == F.col("e1"))
        .groupBy("community_id")
        .agg(F.sum("degree").alias("edges"), F.count(F.lit(1)).alias("size"))
    )
    return sizes.withColumn("density", F.col("edges") / F.greatest(F.col("size") * (F.col("size") - 1), F.lit(1)))


def community_sizes(assignments: dict[str, DataFrame]) -> DataFrame:
    """Members per community of several assignments, tagged by their name."""
    tagged = [df.select("community_id", F.lit(name).alias("cat")) for name, df in assignments.items()]
    rows = tagged[0]
    for other in tagged[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("community_id", "cat").agg(F.count(F.lit(1)).alias("members"))


def user_contribution(bipartite: DataFrame, touches: DataFrame | None = None) -> DataFrame:
    """log(sum(log(words + 1)) + 1) per user and quarter, from :func:`quarter_touches` where they are at hand."""
    if touches is not None:
        return touches.filter("leads").select("user_id", "year", "quarter", "yval")
    return bipartite.groupBy(
        "user_id", F.year("edit_date").alias("year"), F.quarter("edit_date").alias("quarter")
    ).agg(F.log(F.sum(F.log(F.col("word_count") + 1)) + 1).alias("yval"))


def assigned(contributions: DataFrame, communities: DataFrame) -> DataFrame:
    """Contributions with their community and its mean and size over all rows.

    The community figures come from a grouped join, not a window, so a community holding most
    rows is pre-aggregated instead of being sorted in one task.
    """
    rows = contributions.join(communities, "user_id")
    figures = rows.groupBy("community_id").agg(F.avg("yval").alias("avg_yval"), F.count(F.lit(1)).alias("c_size"))
    return rows.join(figures, "community_id")


def first_period_row(df: DataFrame, values: list[str]) -> DataFrame:
    """Each user's values in their first (year, quarter)."""
    order = F.struct("year", "quarter")
    picked = df.groupBy("user_id").agg(F.min_by(F.struct("year", "quarter", *values), order).alias("f"))
    return picked.select("user_id", "f.*")


def user_community_features(contributions: DataFrame, communities: DataFrame) -> DataFrame:
    """Mean and size over all rows of the community of each user with a contribution.

    The figures are the same in every quarter of a user, so quarters are summed per user before they meet the communities.
    """
    sums = contributions.groupBy("user_id").agg(F.sum("yval").alias("sum_yval"), F.count("yval").alias("valued"), F.count(F.lit(1)).alias("rows"))
    rows = sums.join(communities, "user_id")
    figures = rows.groupBy("community_id").agg(
        (F.sum("sum_yval") / F.nullif(F.sum("valued"), F.lit(0))).alias("avg_yval"), F.sum("rows").alias("c_size")
    )
    found = rows.join(figures, "community_id").groupBy("user_id")
    return found.agg(F.min_by(F.struct("avg_yval", "c_size"), "community_id").alias("f")).select("user_id", "f.*")


def article_days(bipartite: DataFrame) -> DataFrame:
    """Days each user touched an article in a quarter: the weight of the (user, article, quarter)."""
    return bipartite.groupBy(
        "user_id", "article_id", F.year("edit_date").alias("year"), F.quarter("edit_date").alias("quarter")
    ).agg(F.count(F.lit(1)).alias("days"))


def quarter_touches(bipartite: DataFrame) -> DataFrame:
    """(user, article, year, quarter, days, yval, leads): :func:`article_days` with the user's contribution of the quarter, written.

    ``leads`` marks one row of each (user, quarter). With edges dealt by quarter this takes no shuffle.
    """
    if "first_day" not in bipartite.columns:
        bipartite = bipartite.withColumn("first_day", F.trunc("edit_date", "quarter"))
    touched = bipartite.groupBy("user_id", "article_id", "first_day").agg(
        F.count(F.lit(1)).alias("days"), F.sum(F.log(F.col("word_count") + 1)).alias("effort")
    )
    mine = Window.partitionBy("user_id", "first_day")
    rows = touched.withColumn("yval", F.log(F.sum("effort").over(mine) + 1))
    rows = rows.withColumn("leads", F.row_number().over(mine.orderBy("article_id")) == 1)
    period = F.year("first_day").alias("year"), F.quarter("first_day").alias("quarter")
    return cut_lineage(rows.select("user_id", "article_id", *period, "days", "yval", "leads"))


def article_contribution(bipartite: DataFrame, days: DataFrame | None = None, contributions: DataFrame | None = None) -> DataFrame:
    """Summed contribution and number of contributor days per (article, quarter); the two tables it joins may be at hand."""
    days = article_days(bipartite) if days is None else days
    contributions = user_contribution(bipartite) if contributions is None else contributions
    rows = days.join(contributions, ["user_id", "year", "quarter"])
    return rows.groupBy("article_id", "year", "quarter").agg(
        F.sum(F.col("yval") * F.col("days")).alias("sum_yval"), F.sum("days").alias("num")
    )


def article_community_values(contributions: DataFrame, communities: DataFrame) -> DataFrame:
    """Article contributions with the contributor-weighted mean of their community."""
    rows = contributions.join(communities, "article_id")
    figures = rows.groupBy("community_id").agg(
        (F.sum("sum_yval") / F.sum("num")).alias("avg_yval"), F.count(F.lit(1)).alias("c_size")
    )
    return rows.join(figures, "community_id").select(
        "article_id",
        "year",
        "quarter",
        "community_id",
        "avg_yval",
        "c_size",
        (F.col("sum_yval") / F.col("num")).alias("self_yval"),
        F.col("num").alias("self_csize"),
    )


def article_community_features(bipartite: DataFrame, communities: DataFrame, touches: DataFrame | None = None) -> DataFrame:
    """Means over a user's first quarter of article-community values, and of articles by themselves.

    Values are those of :func:`article_community_values`. Only touches of first quarters meet them; a user none of whose articles of
    that quarter has a community is looked up in all quarters. ``touches`` has :func:`quarter_touches` where they are at hand.
    """
    touches = quarter_touches(bipartite) if touches is None else touches
    touches = touches.filter("year IS NOT NULL AND quarter IS NOT NULL")
    keys = ["article_id", "year", "quarter"]
    held = communities.filter("community_id IS NOT NULL").groupBy("article_id", "community_id").agg(F.count(F.lit(1)).alias("copies"))
    # Touches meet the communities of their article before they are summed, so one shuffle serves both.
    found = touches.select(*keys, "days", "yval").join(held, "article_id").groupBy(*keys, "community_id", "copies")
    found = cut_lineage(found.agg(F.sum(F.col("yval") * F.col("days")).alias("sum_yval"), F.sum("days").alias("num")))
    copies = F.col("copies")
    figures = found.groupBy("community_id").agg(
        (F.sum(F.col("sum_yval") * copies) / F.sum(F.col("num") * copies)).alias("avg_yval"), F.sum("copies").alias("avg_csize")
    )
    means = ["avg_yval", "avg_csize", "avg_syval", "avg_scsize"]

    def mean(name: str):
        days = F.col("days") * copies
        return (F.sum(F.col(name) * days) / F.nullif(F.sum(F.when(F.col(name).isNotNull(), days)), F.lit(0))).alias(name)

    def per_quarter(touched: DataFrame) -> DataFrame:
        values = touched.select("user_id", *keys, "days").join(found, keys).join(figures, "community_id")
        values = values.withColumns({"avg_syval": F.col("sum_yval") / F.col("num"), "avg_scsize": F.col("num")})
        return values.groupBy("user_id", "year", "quarter").agg(*[mean(name) for name in means])

    firsts = cut_lineage(first_period_row(touches.filter("leads").select("user_id", "year", "quarter"), []))
    features = cut_lineage(per_quarter(touches.join(firsts, ["user_id", "year", "quarter"])).select("user_id", *means))
    missed = firsts.join(features, "user_id", "left_anti").select("user_id")
    if missed.isEmpty():
        return features
    later = per_quarter(touches.join(missed, "user_id", "left_semi"))
    return features.unionByName(first_period_row(later, means).select("user_id", *means))


def members_with_contribution(communities: DataFrame, contributions: DataFrame) -> DataFrame:
    """(u_id, c_id, contrib) of users with both a community and a contribution."""
    return communities.join(contributions, "user_id").select(
        F.col("user_id").alias("u_id"), F.col("community_id").alias("c_id"), "contrib"
    )


def community_base(members: DataFrame) -> DataFrame:
    return members.groupBy("c_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.sum("contrib").alias("sum_contrib"),
        F.sum(F.log(F.col("contrib") + 1)).alias("sum_lcontrib"),
    )


def cross_community_links(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges of each user into every other community."""
    own = members.select(F.col("u_id").alias("e1"), F.col("c_id").alias("own_c"))
    other = members.select(F.col("u_id").alias("e2"), "c_id")
    # Neighbours are counted per (user, community) before the user's own community is looked up.
    links = both_ways(edges).join(other, "e2").groupBy("e1", "c_id").agg(F.count(F.lit(1)).alias("num"))
    return links.join(own, "e1").filter(F.col("c_id") != F.col("own_c")).select(F.col("e1").alias("u_id"), "c_id", "num")


def community_interactions(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Means over the other communities a user touches, and of the own community without the user."""
    base = community_base(members)
    others = (
        cross_community_links(edges, members)
        .join(base, "c_id")
        .groupBy("u_id")
        .agg(
            F.avg(F.col("sum_contrib") / F.col("members")).alias("avg_icontrib"),
            F.avg(F.col("sum_lcontrib") / F.col("members")).alias("avg_licontrib"),
        )
    )
    rest = F.greatest(F.col("members") - 1, F.lit(1))
    return (
        members.join(base, "c_id")
        .join(others, "u_id")
        .select(
            "u_id",
            "avg_icontrib",
            "avg_licontrib",
            ((F.col("sum_contrib") - F.col("contrib")) / rest).alias("avg_contrib"),
            ((F.col("sum_lcontrib") - F.log(F.col("contrib") + 1)) / rest).alias("avg_lcontrib"),
        )
    )


def user_summary(registered: DataFrame) -> DataFrame:
    """Articles, edits and log words of each registered user; one row per touched article on the way."""
    return (
        registered.groupBy("user_id", "article_id")
        .agg(
            F.sum("textdata").alias("words"),
            F.sum(C.log_words(F.col("textdata"))).alias("log_words"),
            F.sum(F.log("textdata")).alias("strict_log_words"),
            F.count(F.lit(1)).alias("edits"),
        )
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("n_articles"),
            F.sum("edits").alias("n_edits"),
            F.log(F.sum("words") + 1).alias("edit_count"),
            F.sum("log_words").alias("sum_log_words"),
            F.sum("strict_log_words").alias("sum_strict_log_words"),
        )
    )


def community_admin_summary(summary: DataFrame, admins: DataFrame, communities: DataFrame) -> DataFrame:
    """Users, admins, log words and edits per community; users without one are community -1."""
    flags = admins.select("user_id", F.lit(1).alias("is_admin"))
    rows = summary.join(flags, "user_id", "left").join(communities, "user_id", "left")
    return (
        rows.na.fill({"is_admin": 0, "community_id": -1})
        .groupBy("community_id")
        .agg(
            F.count(F.lit(1)).alias("n_users"),
            F.sum("is_admin").alias("n_admins"),
            F.sum("edit_count").alias("edit_count"),
            F.sum("n_edits").alias("n_edits"),
        )
    )


def unpacked_assignment(labels: DataFrame, assignments: DataFrame, decade: int) -> DataFrame:
    """Communities of dense ids, mapped back to (id, year, quarter) through the node label table."""
    rows = labels.join(assignments, "dense_id")
    parts = C.unpack_node_id(F.col("packed"), decade)
    return rows.select(*[column.alias(name) for name, column in parts.items()], "community_id")


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Newman modularity and deviation to indeterminism of an assignment (node, community_id)."""
    ways = both_ways(edges, "weight")
    degrees = ways.groupBy(F.col("e1").alias("node")).agg(F.sum("weight").alias("k"))
    sides = communities.join(degrees, "node").groupBy("community_id").agg(
        F.sum("k").alias("tot"), F.count(F.lit(1)).alias("size")
    )
    first = communities.select(F.col("node").alias("e1"), "community_id")
    second = communities.select(F.col("node").alias("e2"), F.col("community_id").alias("other"))
    inner = (
        edges.join(first, "e1")
        .join(second, "e2")
        .filter(F.col("community_id") == F.col("other"))
        .groupBy("community_id")
        .agg((2 * F.sum("weight")).alias("inner"))
    )
    return modularity_of_sides(sides.join(inner, "community_id", "left").na.fill(0, ["inner"]))


def modularity_of_sides(sides: DataFrame) -> DataFrame:
    """Both scores from per-community degree totals, sizes and inner weights (both directions)."""
    totals = sides.agg(F.struct(F.sum("tot").alias("m2"), F.sum("size").alias("n"))).scalar()
    rows = sides.withColumn("_t", totals)
    m2, n = F.col("_t.m2").cast("double"), F.col("_t.n").cast("double")
    tot, size, inner = (F.col(c).cast("double") for c in ("tot", "size", "inner"))
    return rows.agg(
        F.sum(inner / m2 - (tot / m2) * (tot / m2)).alias("modularity"),
        F.sum(inner / m2 - 2 * size * tot / (n * m2) + (size / n) * (size / n)).alias("indeterminism"),
    )
