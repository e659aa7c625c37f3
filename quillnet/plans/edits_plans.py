"""Filters, flags, ranks, sorts and set operations over the edit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillnet.functions import columns as C
from quillnet.operators import bipartite as B
from quillnet.operators import edits as E
from quillnet.operators import projection as P
from quillnet.plans.registry import query
from quillnet.plans.views import uniform
from quillnet.sources import warehouse as W

PERIOD = "1996-1"
RANGE = ("1996-01-01 00:00:00", "1996-07-01 00:00:00")
EDIT_COLUMNS = ["rev_id", "article_id", "user_id", "username", "timestamp", "minor", "textdata", "year", "quarter"]
EDIT_SQL = 'rev_id, article_id, user_id, username, "timestamp", minor, textdata, year, quarter'


@query("human_edits", uses="human", sql=f"SELECT {EDIT_SQL} FROM human")
def human_edits(spark, folder):
    return E.human_edits(W.edits(spark, folder)).select(*EDIT_COLUMNS)


@query("registered_edits", uses="registered", sql=f"SELECT {EDIT_SQL} FROM registered")
def registered_edits(spark, folder):
    return E.registered_edits(W.edits(spark, folder)).select(*EDIT_COLUMNS)


@query(
    "period_columns",
    uses="edits",
    sql="""SELECT rev_id, article_id, concat(year, '-', quarter) AS period,
      date_trunc('quarter', "timestamp")::TIMESTAMP AS t FROM edits""",
)
def period_columns(spark, folder):
    return E.with_period(W.edits(spark, folder, username=False)).select("rev_id", "article_id", "period", "t")


@query(
    "day_bucket",
    uses="edits",
    sql="""SELECT rev_id, article_id, CAST("timestamp" AS DATE) AS edit_date,
      CAST(dayofyear("timestamp") AS INT) AS edit_day FROM edits""",
)
def day_bucket(spark, folder):
    return E.with_day(W.edits(spark, folder, username=False)).select("rev_id", "article_id", "edit_date", "edit_day")


@query(
    "period_filter",
    uses="edits",
    sql=f"SELECT {EDIT_SQL} FROM edits WHERE concat(year, '-', quarter) = '{PERIOD}'",
)
def period_filter(spark, folder):
    return E.in_period(W.edits(spark, folder), PERIOD).select(*EDIT_COLUMNS)


@query(
    "time_range_counts",
    uses="edits",
    sql=f"""SELECT count(DISTINCT user_id) AS users, count(DISTINCT article_id) AS articles,
      count(DISTINCT (user_id, article_id)) AS pairs FROM edits
    WHERE "timestamp" > TIMESTAMP '{RANGE[0]}' AND "timestamp" < TIMESTAMP '{RANGE[1]}'""",
)
def time_range_counts(spark, folder):
    return E.time_range_counts(W.edits(spark, folder, username=False), *RANGE)


@query(
    "pack_node_id",
    uses="registered",
    sql="""SELECT DISTINCT year, quarter, user_id,
      CAST(concat(quarter, year % 10, user_id) AS BIGINT) AS packed FROM registered""",
)
def pack_node_id(spark, folder):
    rows = E.registered_edits(W.edits(spark, folder, username=False)).select("year", "quarter", "user_id").distinct()
    return rows.withColumn("packed", C.pack_node_id(F.col("user_id"), F.col("year"), F.col("quarter")))


@query(
    "unpack_node_id",
    uses="registered",
    more="""packed_ids AS (SELECT DISTINCT CAST(concat(quarter, year % 10, user_id) AS BIGINT) AS packed
      FROM registered)""",
    sql="""SELECT packed, CAST(left(packed::VARCHAR, 1) AS INT) AS quarter,
      CAST(CASE WHEN substr(packed::VARCHAR, 2, 1) >= '5' THEN concat('199', substr(packed::VARCHAR, 2, 1))
           ELSE concat('200', substr(packed::VARCHAR, 2, 1)) END AS INT) AS year,
      CAST(right(packed::VARCHAR, length(packed::VARCHAR) - 2) AS BIGINT) AS node_id FROM packed_ids""",
)
def unpack_node_id(spark, folder):
    rows = E.registered_edits(W.edits(spark, folder, username=False))
    packed = rows.select(C.pack_node_id(F.col("user_id"), F.col("year"), F.col("quarter")).alias("packed")).distinct()
    parts = C.unpack_node_id(F.col("packed"), decade=1995)
    return packed.select("packed", *[column.alias(name) for name, column in parts.items()])


@query(
    "row_sample",
    uses="edits",
    sql=f"""SELECT rev_id, article_id, user_id FROM edits
    WHERE {uniform('rev_id', 'article_id', 'user_id')} < 0.1""",
)
def row_sample(spark, folder):
    rows = W.edits(spark, folder, username=False)
    return E.hashed_sample(rows, 0.1, "rev_id", "article_id", "user_id").select("rev_id", "article_id", "user_id")


@query(
    "anon_flag",
    uses="edits",
    sql="""SELECT rev_id, article_id, user_id, TRY_CAST(user_id AS BIGINT) IS NULL AS anonymous FROM edits""",
)
def anon_flag(spark, folder):
    rows = E.anonymous_flag(W.edits(spark, folder, username=False))
    return rows.select("rev_id", "article_id", "user_id", "anonymous")


@query(
    "admin_flag",
    uses="admins",
    sql="""SELECT c_custkey AS user_id, CAST(a.username IS NOT NULL AS INT) AS is_admin
    FROM customer LEFT JOIN admins a ON c_custkey = a.user_id""",
)
def admin_flag(spark, folder):
    people = W.table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    return people.join(W.admins(spark, folder), "user_id", "left").select(
        "user_id", F.col("username").isNotNull().cast("int").alias("is_admin")
    )


@query(
    "fill_missing",
    uses="bipartite roles admins",
    sql="""SELECT user_id, article_id, edit_date, round(coalesce(word_count, 0), 6) AS word_count,
      coalesce(role_id, -1) AS role_id, coalesce(username, 'none') AS admin_name
    FROM bipartite LEFT JOIN roles USING (user_id) LEFT JOIN admins USING (user_id)""",
)
def fill_missing(spark, folder):
    rows = B.bipartite_edges(W.edits(spark, folder, username=False))
    rows = rows.join(W.role_labels(spark, folder), "user_id", "left")
    rows = rows.join(W.admins(spark, folder), "user_id", "left")
    rows = E.fill_missing(rows, {"word_count": 0.0, "role_id": -1, "username": "none"})
    return rows.select(
        "user_id",
        "article_id",
        "edit_date",
        F.round("word_count", 6).alias("word_count"),
        "role_id",
        F.col("username").alias("admin_name"),
    )


@query(
    "ratio_rounding",
    uses="human",
    sql="""SELECT user_id, round(count(DISTINCT article_id) * 1.0 / count(*), 4) AS p_distinct,
      round(sum(minor::INT) * 1.0 / count(*), 4) AS p_minors FROM human GROUP BY 1""",
)
def ratio_rounding(spark, folder):
    rows = E.human_edits(W.edits(spark, folder)).groupBy("user_id").agg(
        F.countDistinct("article_id").alias("articles"),
        F.sum(F.col("minor").cast("int")).alias("minors"),
        F.count(F.lit(1)).alias("n"),
    )
    return rows.select(
        "user_id",
        E.ratio(F.col("articles"), F.col("n")).alias("p_distinct"),
        E.ratio(F.col("minors"), F.col("n")).alias("p_minors"),
    )


@query(
    "edit_ranks",
    uses="human",
    sql="""SELECT rev_id, article_id, user_id, "timestamp",
      rank() OVER (PARTITION BY article_id ORDER BY "timestamp") AS article_rank,
      rank() OVER (PARTITION BY user_id ORDER BY "timestamp") AS user_rank FROM human""",
)
def edit_ranks(spark, folder):
    rows = E.human_edits(W.edits(spark, folder)).select("rev_id", "article_id", "user_id", "timestamp")
    return E.edit_ranks(rows).select("rev_id", "article_id", "user_id", "timestamp", "article_rank", "user_rank")


@query(
    "first_quarter_window",
    uses="human",
    sql="""SELECT rev_id, article_id, user_id, t,
      date_trunc('quarter', min("timestamp") OVER (PARTITION BY user_id))::TIMESTAMP AS fq_t FROM human""",
)
def first_quarter_window(spark, folder):
    human = E.human_edits(W.edits(spark, folder))
    return human.join(E.first_quarters(human), "user_id").select(
        "rev_id",
        "article_id",
        "user_id",
        C.quarter_start(F.col("timestamp")).alias("t"),
        F.col("first_quarter").alias("fq_t"),
    )


@query(
    "first_quarter_edits",
    uses="human firsts",
    sql="""SELECT rev_id, article_id, user_id, t FROM human JOIN firsts USING (user_id)
    WHERE t = first_quarter""",
)
def first_quarter_edits(spark, folder):
    rows = E.first_quarter_edits(E.human_edits(W.edits(spark, folder)))
    return rows.select("rev_id", "article_id", "user_id", "t")


@query(
    "next_period_contribution",
    uses="contribs",
    sql="SELECT user_id, round(contrib, 6) AS contrib FROM contribs",
)
def next_period_contribution(spark, folder):
    rows = E.next_period_contribution(E.human_edits(W.edits(spark, folder)))
    return rows.select("user_id", C.rounded(F.col("contrib")).alias("contrib"))


@query(
    "left_label_join",
    uses="firsts contribs",
    sql="""SELECT user_id, first_quarter, round(coalesce(contrib, 0), 6) AS y
    FROM firsts LEFT JOIN contribs USING (user_id)""",
)
def left_label_join(spark, folder):
    human = E.human_edits(W.edits(spark, folder))
    labels = E.next_period_contribution(human)
    return E.first_quarters(human).join(labels, "user_id", "left").select(
        "user_id", "first_quarter", C.rounded(F.coalesce("contrib", F.lit(0.0))).alias("y")
    )


@query(
    "admin_tag",
    uses="registered admins",
    sql="""SELECT DISTINCT r.user_id, r.username, a.username IS NOT NULL AS is_admin
    FROM registered r LEFT JOIN admins a ON r.username = a.username""",
)
def admin_tag(spark, folder):
    # The list of names is joined by size: Spark broadcasts it only while it is small.
    people = E.registered_edits(W.edits(spark, folder)).select("user_id", "username").distinct()
    names = W.admins(spark, folder).select("username", F.lit(True).alias("is_admin"))
    return people.join(names, "username", "left").select(
        "user_id", "username", F.coalesce("is_admin", F.lit(False)).alias("is_admin")
    )


@query(
    "sort_rows",
    uses="human",
    sql="""SELECT user_id, count(*) AS num_edits FROM human GROUP BY 1
    ORDER BY num_edits DESC, CAST(user_id AS BIGINT)""",
)
def sort_rows(spark, folder):
    rows = E.human_edits(W.edits(spark, folder)).groupBy("user_id").agg(F.count(F.lit(1)).alias("num_edits"))
    return rows.orderBy(F.desc("num_edits"), F.col("user_id").cast("bigint"))


@query(
    "top_k",
    uses="human",
    sql="""SELECT user_id, count(*) AS num_edits, CAST(sum(textdata) AS BIGINT) AS words FROM human GROUP BY 1
    ORDER BY num_edits DESC, CAST(user_id AS BIGINT) LIMIT 20""",
)
def top_k(spark, folder):
    rows = E.human_edits(W.edits(spark, folder)).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("num_edits"), F.sum("textdata").alias("words")
    )
    return rows.orderBy(F.desc("num_edits"), F.col("user_id").cast("bigint")).limit(20)


@query(
    "symmetrise_edges",
    uses="network",
    sql="SELECT e1, e2 FROM network UNION SELECT e2, e1 FROM network",
)
def symmetrise_edges(spark, folder):
    return P.symmetrise(P.user_network(B.memberships(W.edits(spark, folder, username=False))))


@query(
    "tagged_union",
    uses="user_comms article_comms",
    sql="""SELECT user_id AS node, community_id, 'users' AS cat FROM user_comms
    UNION ALL SELECT article_id, community_id, 'articles' FROM article_comms""",
)
def tagged_union(spark, folder):
    users = W.user_communities(spark, folder).withColumnRenamed("user_id", "node").withColumn("cat", F.lit("users"))
    articles = W.article_communities(spark, folder).withColumnRenamed("article_id", "node")
    return users.unionByName(articles.withColumn("cat", F.lit("articles")))


@query("node_set", uses="network", sql="SELECT e1 AS node FROM network UNION SELECT e2 FROM network")
def node_set(spark, folder):
    return P.node_set(P.user_network(B.memberships(W.edits(spark, folder, username=False))))


@query(
    "dense_node_ids",
    uses="network",
    more="nodes AS (SELECT e1 AS node FROM network UNION SELECT e2 FROM network)",
    sql="SELECT node, rank() OVER (ORDER BY node) AS rank FROM nodes",
)
def dense_node_ids(spark, folder):
    return P.dense_ids(P.user_network(B.memberships(W.edits(spark, folder, username=False))))


@query(
    "relabel_edges",
    uses="network",
    more="""nodes AS (SELECT e1 AS node FROM network UNION SELECT e2 FROM network),
    ids AS (SELECT node, rank() OVER (ORDER BY node) AS rank FROM nodes)""",
    sql="""SELECT a.rank AS e1, b.rank AS e2, weight FROM network
    JOIN ids a ON e1 = a.node JOIN ids b ON e2 = b.node""",
)
def relabel_edges(spark, folder):
    return P.relabel(P.user_network(B.memberships(W.edits(spark, folder, username=False))), "weight")[1]
