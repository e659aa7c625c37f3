"""Contributor-article graphs and their projections, whole and sampled."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillnet.functions import columns as C
from quillnet.operators import bipartite as B
from quillnet.operators import distributions as D
from quillnet.operators import edits as E
from quillnet.operators import projection as P
from quillnet.operators import similarity as S
from quillnet.plans.registry import query
from quillnet.plans.views import coin_pairs, counted_pairs
from quillnet.session import cut_lineage
from quillnet.sources import warehouse as W

PERIOD = "1996-1"
THRESHOLDS = list(range(20))
SWEEP = [i / 10 for i in range(11)]
BLOCK = ["article_id", "year", "quarter"]


def plain_edits(spark, folder):
    return W.edits(spark, folder, username=False)


def network(spark, folder):
    """The sampled user network, written once because graph jobs read it many times."""
    return cut_lineage(P.user_network(B.memberships(plain_edits(spark, folder))))


def all_edges(spark, folder):
    """Distinct (user, article) of the whole log."""
    return E.registered_edits(plain_edits(spark, folder)).select("user_id", "article_id").distinct()


@query(
    "bipartite_edges",
    uses="bipartite",
    sql="SELECT user_id, article_id, edit_date, round(word_count, 6) AS word_count, num_edits FROM bipartite",
)
def bipartite_edges(spark, folder):
    return B.bipartite_edges(plain_edits(spark, folder)).withColumn("word_count", C.rounded(F.col("word_count")))


@query(
    "quarter_edges",
    uses="registered",
    sql=f"""SELECT user_id, article_id, CAST(sum(textdata) AS BIGINT) AS word_count, count(*) AS num_edits
    FROM registered WHERE concat(year, '-', quarter) = '{PERIOD}' GROUP BY 1, 2""",
)
def quarter_edges(spark, folder):
    return B.quarter_edges(plain_edits(spark, folder), PERIOD)


@query(
    "day_edges",
    uses="monthly",
    sql="""SELECT user_id, article_id, CAST(dayofyear("timestamp") AS INT) AS edit_day,
      CAST(sum(textdata) AS BIGINT) AS word_count, count(*) AS num_edits FROM monthly GROUP BY 1, 2, 3""",
)
def day_edges(spark, folder):
    return B.day_edges(W.monthly_edits(spark, folder))


@query(
    "snapshot_size",
    uses="registered",
    more="""e AS (SELECT user_id, article_id, year, quarter, count(*) AS num_edits FROM registered
      GROUP BY ALL)""",
    sql="""SELECT year, quarter, count(*) AS edges, count(DISTINCT user_id) AS users,
      count(DISTINCT article_id) AS articles,
      count(DISTINCT CASE WHEN num_edits > 1 THEN user_id END) AS repeat_users FROM e GROUP BY 1, 2""",
)
def snapshot_size(spark, folder):
    edges = (
        E.registered_edits(plain_edits(spark, folder))
        .groupBy("user_id", "article_id", "year", "quarter")
        .agg(F.count(F.lit(1)).alias("num_edits"))
    )
    return B.snapshot_size(edges, ["year", "quarter"])


@query(
    "degree_filtered_edges",
    uses="registered",
    more=f"""e AS (SELECT user_id, article_id, CAST(sum(textdata) AS BIGINT) AS word_count, count(*) AS num_edits
      FROM registered WHERE year = 1996 AND quarter = 1 GROUP BY 1, 2),
    d AS (SELECT user_id, count(DISTINCT article_id) AS degree FROM e GROUP BY 1)""",
    sql="SELECT e.*, degree FROM e JOIN d USING (user_id) WHERE degree > 1",
)
def degree_filtered_edges(spark, folder):
    return B.degree_filtered_edges(plain_edits(spark, folder), PERIOD)


USER_EDGES = "ua AS (SELECT DISTINCT user_id, article_id FROM registered)"
USER_PAIRS = f"""{USER_EDGES}, up AS (SELECT a.user_id AS e1, b.user_id AS e2, count(*) AS shared_articles
  FROM ua a JOIN ua b USING (article_id) WHERE a.user_id < b.user_id GROUP BY 1, 2)"""


@query("user_projection", uses="registered", more=USER_PAIRS, sql="SELECT e1, e2, shared_articles FROM up")
def user_projection(spark, folder):
    return P.user_projection(all_edges(spark, folder))


@query(
    "user_projection_symmetric",
    uses="registered",
    more=USER_EDGES,
    sql="""SELECT a.user_id AS e1, b.user_id AS e2, count(*) AS shared_articles
    FROM ua a JOIN ua b USING (article_id) GROUP BY 1, 2 HAVING count(*) > 1""",
)
def user_projection_symmetric(spark, folder):
    return P.user_projection_symmetric(all_edges(spark, folder))


@query(
    "weight_threshold",
    uses="registered",
    more=USER_PAIRS,
    sql="SELECT e1, e2, shared_articles FROM up WHERE shared_articles > 2",
)
def weight_threshold(spark, folder):
    return P.weight_threshold(P.user_projection(all_edges(spark, folder)), 2)


@query(
    "threshold_edge_lists",
    uses="registered",
    more=USER_PAIRS,
    sql="""SELECT threshold, count(*) AS edges, count(DISTINCT e1) AS sources FROM up
    JOIN (VALUES (2), (3), (4), (5)) t(threshold) ON shared_articles > threshold GROUP BY 1""",
)
def threshold_edge_lists(spark, folder):
    lists = P.threshold_edge_lists(P.user_projection(all_edges(spark, folder)), [5, 4, 3, 2])
    return lists.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("edges"), F.countDistinct("e1").alias("sources")
    )


@query(
    "threshold_sweep",
    uses="registered",
    more=f"""{USER_PAIRS}, ends AS (SELECT node, max(shared_articles) AS w FROM
      (SELECT e1 AS node, shared_articles FROM up UNION ALL SELECT e2, shared_articles FROM up) GROUP BY 1),
    ts AS (SELECT CAST(range AS INT) AS threshold FROM range(20)),
    counted AS (SELECT threshold, (SELECT count(*) FROM ends WHERE w > threshold) AS nodes,
      (SELECT count(*) FROM up WHERE shared_articles > threshold) AS edges FROM ts)""",
    sql="""SELECT threshold, nodes, edges, round(CASE WHEN nodes > 1 THEN edges / (nodes * (nodes - 1) / 2)
      ELSE 0.0 END, 9) AS density FROM counted""",
)
def threshold_sweep(spark, folder):
    edges = cut_lineage(P.user_projection(all_edges(spark, folder)))
    return D.threshold_sweep(edges, THRESHOLDS).withColumn("density", C.rounded(F.col("density"), 9))


@query(
    "weight_percentiles",
    uses="registered",
    more=USER_PAIRS,
    sql="""SELECT min(shared_articles) AS smallest, max(shared_articles) AS largest,
      CAST(quantile_disc(shared_articles, 0.25) AS DOUBLE) AS p25, CAST(quantile_disc(shared_articles, 0.5) AS DOUBLE) AS p50,
      CAST(quantile_disc(shared_articles, 0.75) AS DOUBLE) AS p75, CAST(quantile_disc(shared_articles, 0.9) AS DOUBLE) AS p90,
      CAST(quantile_disc(shared_articles, 0.95) AS DOUBLE) AS p95, CAST(quantile_disc(shared_articles, 0.99) AS DOUBLE) AS p99
    FROM up""",
)
def weight_percentiles(spark, folder):
    fractions = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    row = P.user_projection(all_edges(spark, folder)).agg(
        F.min("shared_articles").alias("smallest"),
        F.max("shared_articles").alias("largest"),
        F.percentile_approx(F.col("shared_articles").cast("double"), fractions).alias("p"),
    )
    names = ["p25", "p50", "p75", "p90", "p95", "p99"]
    return row.select("smallest", "largest", *[F.col("p")[i].alias(n) for i, n in enumerate(names)])


@query(
    "weight_counts",
    uses="registered",
    more=USER_PAIRS,
    sql="""SELECT threshold, count(e1) AS edges FROM (VALUES (1), (2), (3), (4), (5), (10), (20), (50), (100), (200),
      (500), (1000)) t(threshold) LEFT JOIN up ON shared_articles > threshold GROUP BY 1""",
)
def weight_counts(spark, folder):
    edges = P.user_projection(all_edges(spark, folder))
    return D.counts_above(edges, "shared_articles", [1, 2, 3, 4, 5, 10, 20, 50, 100, 200, 500, 1000], "edges")


@query(
    "daily_block_projection",
    uses="monthly",
    more="""m AS (SELECT DISTINCT user_id, article_id, CAST("timestamp" AS DATE) AS d FROM monthly)""",
    sql="""SELECT a.user_id AS e1, b.user_id AS e2, count(*) AS shared_articles FROM m a JOIN m b USING (article_id, d)
    WHERE a.user_id < b.user_id GROUP BY 1, 2""",
)
def daily_block_projection(spark, folder):
    rows = W.monthly_edits(spark, folder).select("user_id", "article_id", F.to_date("timestamp").alias("edit_date"))
    return P.daily_block_projection(rows)


@query(
    "projection_pairs",
    uses="monthly",
    more="""m AS (SELECT DISTINCT user_id, article_id, CAST("timestamp" AS DATE) AS edit_date FROM monthly)""",
    sql="""SELECT a.user_id AS e1, b.user_id AS e2, article_id, edit_date FROM m a JOIN m b USING (article_id, edit_date)
    WHERE a.user_id < b.user_id""",
)
def projection_pairs(spark, folder):
    rows = W.monthly_edits(spark, folder).select("user_id", "article_id", F.to_date("timestamp").alias("edit_date"))
    return P.group_pairs(rows, ["article_id", "edit_date"], "user_id")


@query(
    "article_projection",
    uses="registered",
    more=USER_EDGES,
    sql="""SELECT a.article_id AS e1, b.article_id AS e2, user_id FROM ua a JOIN ua b USING (user_id)
    WHERE a.article_id < b.article_id""",
)
def article_projection(spark, folder):
    return P.group_pairs(all_edges(spark, folder), ["user_id"], "article_id")


QUARTER_SETS = "qs AS (SELECT DISTINCT year, quarter, user_id, article_id FROM registered), " \
    "qd AS (SELECT year, quarter, user_id, count(*) AS d FROM qs GROUP BY ALL)"
QUARTER_DISTANCES = f"""{QUARTER_SETS}, qn AS (SELECT year, quarter, a.user_id AS e1, b.user_id AS e2, count(*) AS n
  FROM qs a JOIN qs b USING (year, quarter, article_id) WHERE a.user_id < b.user_id GROUP BY ALL),
qj AS (SELECT year, quarter, e1, e2, 1.0::DOUBLE - n / (x.d + y.d - n) AS distance FROM qn
  JOIN qd x USING (year, quarter) JOIN qd y USING (year, quarter)
  WHERE x.user_id = e1 AND y.user_id = e2)"""


def _hash_mins() -> str:
    return ", ".join(
        f"min((((article_id + 1) % {S.HASH_PRIME}) * {a} + {b}) % {S.HASH_PRIME}) AS h{i}"
        for i, (a, b) in enumerate(S.hash_family(5))
    )


@query(
    "jaccard_similarity_join",
    uses="registered",
    more=f"""{QUARTER_DISTANCES}, qh AS (SELECT year, quarter, user_id, {_hash_mins()} FROM qs GROUP BY 1, 2, 3)""",
    sql="""SELECT year, quarter, e1, e2, round(distance, 9) AS distance FROM qj
    JOIN qh a USING (year, quarter) JOIN qh b USING (year, quarter)
    WHERE a.user_id = e1 AND b.user_id = e2 AND distance < 0.6
      AND (a.h0 = b.h0 OR a.h1 = b.h1 OR a.h2 = b.h2 OR a.h3 = b.h3 OR a.h4 = b.h4)""",
)
def jaccard_similarity_join(spark, folder):
    pairs = S.minhash_close_pairs(
        B.memberships(plain_edits(spark, folder)), ["year", "quarter"], "user_id", "article_id", 0.6
    )
    return pairs.withColumn("distance", C.rounded(F.col("distance"), 9))


@query(
    "jaccard_similarity_exact",
    uses="registered",
    more=QUARTER_DISTANCES,
    sql="SELECT year, quarter, e1, e2, round(distance, 9) AS distance FROM qj WHERE distance < 0.6",
)
def jaccard_similarity_exact(spark, folder):
    # Dealt by block, so that repeats and the users of an item are counted without a further shuffle.
    edits = plain_edits(spark, folder).select(*BLOCK, "user_id").repartition(*BLOCK)
    pairs = S.close_pairs(B.memberships(edits), ["year", "quarter"], "user_id", "article_id", 0.6)
    return pairs.withColumn("distance", C.rounded(F.col("distance"), 9))


@query(
    "similarity_sweep",
    uses="registered",
    more=f"""{QUARTER_DISTANCES}, ts AS (SELECT unnest({SWEEP}::DOUBLE[]) AS threshold),
    ends AS (SELECT node, min(distance) AS nearest FROM
      (SELECT e1 AS node, distance FROM qj UNION ALL SELECT e2, distance FROM qj) GROUP BY 1)""",
    sql="""SELECT threshold, (SELECT count(*) FROM ends WHERE nearest < threshold) AS nodes,
      (SELECT count(*) FROM qj WHERE distance < threshold) AS edges FROM ts""",
)
def similarity_sweep(spark, folder):
    members = B.memberships(plain_edits(spark, folder))
    pairs = cut_lineage(S.overlapping_pairs(members, ["year", "quarter"], "user_id", "article_id"))
    return S.similarity_sweep(pairs, SWEEP)


@query(
    "clique_keep_probability",
    uses="members",
    more="""b AS (SELECT count(*) AS k FROM members GROUP BY article_id, year, quarter),
    ab AS (SELECT count(DISTINCT article_id) AS k FROM members GROUP BY user_id),
    sizes AS (SELECT DISTINCT k FROM (SELECT k FROM b UNION ALL SELECT k FROM ab) WHERE k > 1)""",
    sql="""SELECT k, round(1 - pow(0.01, 1.0 / (k - 1)), 9) AS p_any,
      round(1 - pow(1 - pow(0.99, 1.0 / k), 1.0 / (k - 1)), 9) AS p_all FROM sizes""",
)
def clique_keep_probability(spark, folder):
    members = B.memberships(plain_edits(spark, folder))
    articles = members.groupBy("user_id").agg(F.countDistinct("article_id").alias("k"))
    sizes = P.block_sizes(members, BLOCK).select("k").union(articles.select("k")).filter(F.col("k") > 1).distinct()
    return sizes.select(
        "k",
        C.rounded(C.keep_probability(F.col("k"), 0.01), 9).alias("p_any"),
        C.rounded(C.keep_probability(F.col("k"), 0.01, "all"), 9).alias("p_all"),
    )


@query(
    "user_blocks",
    uses="members",
    sql="""SELECT article_id, year, quarter, user_id >> 16 AS chunk, count(*) AS n_users,
      string_agg(user_id::VARCHAR, ',' ORDER BY user_id) AS user_set FROM members GROUP BY ALL""",
)
def user_blocks(spark, folder):
    blocks = P.block_chunks(B.memberships(plain_edits(spark, folder)), BLOCK, "user_id", "n_users", "user_set")
    return blocks.withColumn("user_set", F.array_join(F.col("user_set").cast("array<string>"), ","))


@query(
    "article_blocks",
    uses="members",
    more="""packed AS (SELECT user_id, year, quarter, CAST(concat(quarter, year % 10, article_id) AS BIGINT) AS id
      FROM members)""",
    sql="""SELECT user_id, year, quarter, id >> 16 AS chunk, sum(count(*)) OVER (PARTITION BY user_id, year, quarter)::BIGINT
      AS n_articles, string_agg(id::VARCHAR, ',' ORDER BY id) AS article_set FROM packed
    GROUP BY user_id, year, quarter, id >> 16""",
)
def article_blocks(spark, folder):
    members = B.memberships(plain_edits(spark, folder)).withColumn(
        "packed", C.pack_node_id(F.col("article_id"), F.col("year"), F.col("quarter"))
    )
    blocks = P.block_chunks(members, ["user_id", "year", "quarter"], "packed", "n_articles", "article_set")
    return blocks.withColumn("article_set", F.array_join(F.col("article_set").cast("array<string>"), ","))


@query(
    "clique_edges",
    uses="sized",
    sql="""SELECT a.article_id, a.year, a.quarter, a.user_id AS e1, b.user_id AS e2
    FROM sized a JOIN sized b USING (article_id, year, quarter) WHERE a.user_id < b.user_id""",
)
def clique_edges(spark, folder):
    return P.group_pairs(B.memberships(plain_edits(spark, folder)), BLOCK, "user_id")


@query(
    "clique_pair_total",
    uses="members",
    more="b AS (SELECT count(*) AS k FROM members GROUP BY article_id, year, quarter)",
    sql="SELECT count(*) AS blocks, CAST(sum(k * (k - 1) // 2) AS BIGINT) AS pairs, max(k) AS largest FROM b",
)
def clique_pair_total(spark, folder):
    return P.block_sizes(B.memberships(plain_edits(spark, folder)), BLOCK).agg(
        F.count(F.lit(1)).alias("blocks"), F.sum(C.pair_count(F.col("k"))).alias("pairs"), F.max("k").alias("largest")
    )


@query("sampled_user_projection", uses="network", sql="SELECT e1, e2, weight FROM network")
def sampled_user_projection(spark, folder):
    return P.user_network(B.memberships(plain_edits(spark, folder)))


@query(
    "sampled_user_projection_timed",
    uses="kept_pairs",
    sql="""SELECT CAST(concat(quarter, year % 10, e1) AS BIGINT) AS e1, CAST(concat(quarter, year % 10, e2) AS BIGINT) AS e2,
      count(*) AS weight FROM kept_pairs GROUP BY year, quarter, kept_pairs.e1, kept_pairs.e2""",
)
def sampled_user_projection_timed(spark, folder):
    edges = P.timed_user_network(B.memberships(plain_edits(spark, folder)))
    packed = [C.pack_node_id(F.col(e), F.col("year"), F.col("quarter")).alias(e) for e in ("e1", "e2")]
    return edges.select(*packed, "weight")


@query(
    "fixed_count_clique_sample",
    uses="registered",
    more=f"""{USER_EDGES}, coins AS ({coin_pairs('ua', 'user_id', 'article_id', 'k < 10')}),
    counted AS ({counted_pairs('ua', 'user_id', 'article_id', 'k >= 10')})""",
    sql="SELECT user_id, e1, e2 FROM coins UNION ALL SELECT user_id, e1, e2 FROM counted",
)
def fixed_count_clique_sample(spark, folder):
    return P.sampled_pairs(all_edges(spark, folder), ["user_id"], "article_id", exact_count_from=10)


@query(
    "sampled_article_projection",
    uses="members",
    more=f"""coins AS ({coin_pairs('members', 'user_id, year, quarter', 'article_id', 'k < 10')}),
    counted AS ({counted_pairs('members', 'user_id, year, quarter', 'article_id', 'k >= 10')})""",
    sql="""SELECT year, quarter, e1, e2, count(*) AS weight FROM (FROM coins UNION ALL FROM counted) GROUP BY ALL""",
)
def sampled_article_projection(spark, folder):
    return P.article_network(B.memberships(plain_edits(spark, folder)))
