"""Distributions, retention overlaps, percentiles and fits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quillnet.functions import columns as C
from quillnet.operators import bipartite as B
from quillnet.operators import distributions as D
from quillnet.operators import edits as E
from quillnet.operators import projection as P
from quillnet.operators import retention as R
from quillnet.plans.projection_plans import network, plain_edits
from quillnet.plans.registry import query
from quillnet.plans.views import uniform
from quillnet.sources import warehouse as W

FRACTIONS = [0.25, 0.5, 0.75, 0.9, 0.99, 0.999, 0.9999, 0.99999, 0.999999]


def human(spark, folder):
    return E.human_edits(W.edits(spark, folder))


def monthly_bipartite(spark, folder):
    rows = W.monthly_edits(spark, folder)
    return rows.groupBy("user_id", "article_id", F.to_date("timestamp").alias("edit_date")).agg(
        F.sum(F.log("textdata")).alias("word_count"), F.count(F.lit(1)).alias("num_edits")
    )


MONTHLY_CLIQUES = """mb AS (SELECT DISTINCT user_id, article_id, CAST("timestamp" AS DATE) AS edit_date FROM monthly),
cl AS (SELECT article_id, edit_date, count(*) AS n_users, count(*) * (count(*) - 1) // 2 AS clique_edges
  FROM mb GROUP BY 1, 2)"""


def two_level(key, measure, name, total):
    return f"""SELECT {name}, count(*) AS {total} FROM (SELECT {key}, {measure} AS {name} FROM human GROUP BY 1)
    GROUP BY 1"""


@query("article_edit_dist", uses="human", sql=two_level("article_id", "count(*)", "num_edits", "articles"))
def article_edit_dist(spark, folder):
    return D.article_edit_distribution(human(spark, folder))


@query("user_edit_dist", uses="human", sql=two_level("user_id", "count(*)", "num_edits", "users"))
def user_edit_dist(spark, folder):
    return D.user_edit_distribution(human(spark, folder))


@query(
    "edit_word_dist", uses="human", sql="SELECT textdata, count(*) AS edit_count FROM human GROUP BY 1"
)
def edit_word_dist(spark, folder):
    return D.edit_word_distribution(human(spark, folder))


@query(
    "rev_wc",
    uses="human",
    sql="""SELECT edit_count, count(*) AS word_counts FROM
      (SELECT textdata, count(*) AS edit_count FROM human GROUP BY 1) GROUP BY 1""",
)
def rev_wc(spark, folder):
    return D.edit_word_distribution(human(spark, folder)).groupBy("edit_count").agg(
        F.count(F.lit(1)).alias("word_counts")
    )


@query(
    "user_word_dist",
    uses="human",
    sql=two_level("user_id", "CAST(sum(textdata) AS BIGINT)", "total_words", "num_users"),
)
def user_word_dist(spark, folder):
    return D.user_word_distribution(human(spark, folder))


@query(
    "account_duration_dist",
    uses="human",
    sql=two_level(
        "user_id", 'round((epoch(max("timestamp")) - epoch(min("timestamp"))) / 3600 / 24)', "days", "num_users"
    ),
)
def account_duration_dist(spark, folder):
    return D.account_durations(human(spark, folder))


@query(
    "active_days_dist",
    uses="edits",
    sql="""SELECT days, count(*) AS n_users FROM (SELECT user_id, CAST(date_diff('day', min("timestamp"), max("timestamp"))
      AS INT) AS days FROM edits GROUP BY 1) GROUP BY 1""",
)
def active_days_dist(spark, folder):
    return D.active_days(plain_edits(spark, folder))


@query(
    "active_days_quarter_dist",
    uses="edits",
    sql="""SELECT year, quarter, days, count(*) AS n_users FROM (SELECT year, quarter, user_id,
      CAST(date_diff('day', min("timestamp"), max("timestamp")) AS INT) AS days FROM edits GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""",
)
def active_days_quarter_dist(spark, folder):
    return D.active_days(plain_edits(spark, folder), ["year", "quarter"])


@query(
    "degree_dist",
    uses="edits",
    sql="""SELECT degree, count(*) AS n_users FROM (SELECT user_id, count(DISTINCT article_id) AS degree FROM edits
      GROUP BY 1) GROUP BY 1""",
)
def degree_dist(spark, folder):
    return D.degree_distribution(plain_edits(spark, folder))


PERIOD_DEGREES = """pd AS (SELECT period, degree, count(*) AS n_users FROM
  (SELECT concat(year, '-', quarter) AS period, user_id, count(DISTINCT article_id) AS degree FROM edits GROUP BY 1, 2)
  GROUP BY 1, 2)"""


def period_degrees(spark, folder):
    return D.degree_distribution(E.with_period(plain_edits(spark, folder)), ["period"])


@query("degree_dist_by_period", uses="edits", more=PERIOD_DEGREES, sql="SELECT period, degree, n_users FROM pd")
def degree_dist_by_period(spark, folder):
    return period_degrees(spark, folder)


@query(
    "quarter_article_counts",
    uses="edits",
    sql="SELECT year, quarter, count(DISTINCT article_id) AS articles FROM edits GROUP BY 1, 2",
)
def quarter_article_counts(spark, folder):
    return plain_edits(spark, folder).groupBy("year", "quarter").agg(F.countDistinct("article_id").alias("articles"))


@query(
    "category_counts",
    uses="edits",
    sql="SELECT category, count(*) AS n FROM edits GROUP BY 1 ORDER BY 2 DESC",
)
def category_counts(spark, folder):
    rows = W.edits(spark, folder, username=False, category=True)
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query("yearly_edits", uses="edits", sql="SELECT year, count(*) AS n FROM edits GROUP BY 1 ORDER BY 2 DESC")
def yearly_edits(spark, folder):
    return plain_edits(spark, folder).groupBy("year").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query(
    "quarter_anon_stats",
    uses="edits",
    sql="""SELECT year, quarter, TRY_CAST(user_id AS BIGINT) IS NULL AS anonymous, CAST(sum(textdata) AS BIGINT) AS words,
      CAST(sum(minor::INT) AS BIGINT) AS minor_edits, count(DISTINCT user_id) AS n_users, count(*) AS n_edits
    FROM edits GROUP BY 1, 2, 3""",
)
def quarter_anon_stats(spark, folder):
    return D.quarter_anonymous_stats(plain_edits(spark, folder))


RETAINED = """pu AS (SELECT DISTINCT year * 4 + quarter - 1 AS p, user_id FROM registered)"""


@query(
    "retention_overlap",
    uses="registered",
    more=RETAINED,
    sql="""SELECT CAST(a.p // 4 AS INT) AS year, CAST(a.p % 4 + 1 AS INT) AS quarter, lag, count(*) AS users,
      count(b.user_id) AS retained, round(count(b.user_id) / count(*), 9) AS overlap
    FROM pu a JOIN (VALUES (1), (2), (3)) l(lag) ON true LEFT JOIN pu b ON a.user_id = b.user_id AND b.p = a.p + lag
    GROUP BY a.p, lag""",
)
def retention_overlap(spark, folder):
    rows = R.retention_overlap(E.registered_edits(plain_edits(spark, folder)))
    return rows.withColumn("overlap", C.rounded(F.col("overlap"), 9))


def quarter_user_edges(spark, folder):
    rows = E.registered_edits(plain_edits(spark, folder))
    return rows.groupBy("user_id", "article_id", "year", "quarter").agg(F.sum("textdata").alias("word_count"))


QUARTILE_TAIL = """f AS (SELECT DISTINCT p, bucket, user_id FROM placed WHERE lag = 0 AND bucket > 0),
g AS (SELECT DISTINCT p, bucket, user_id FROM placed WHERE lag = 1 AND bucket > 0)"""
QUARTILE_SELECT = """SELECT CAST(f.p // 4 AS INT) AS year, CAST(f.p % 4 + 1 AS INT) AS quarter, f.bucket, count(*) AS users,
  count(g.user_id) AS retained, round(count(g.user_id) / count(*), 9) AS overlap
FROM f LEFT JOIN g ON f.p = g.p AND f.bucket = g.bucket AND f.user_id = g.user_id GROUP BY f.p, f.bucket"""


@query(
    "retention_by_words_quartile",
    uses="registered",
    more=f"""e AS (SELECT year * 4 + quarter - 1 AS p, user_id, article_id, sum(textdata) AS x FROM registered
      GROUP BY 1, 2, 3),
    c AS (SELECT p, quantile_cont(x::DOUBLE, 0.25) AS a, quantile_cont(x::DOUBLE, 0.5) AS b, quantile_cont(x::DOUBLE, 0.75) AS c
      FROM e GROUP BY 1),
    placed AS (SELECT c.p, lag, user_id, CASE WHEN x < a THEN 1 WHEN x > a AND x < b THEN 2
      WHEN x > b AND x < c THEN 3 WHEN x > c THEN 4 ELSE 0 END AS bucket
      FROM c JOIN (VALUES (0), (1)) l(lag) ON true JOIN e ON e.p = c.p + lag), {QUARTILE_TAIL}""",
    sql=QUARTILE_SELECT,
)
def retention_by_words_quartile(spark, folder):
    return R.retention_by_words(quarter_user_edges(spark, folder)).withColumn("overlap", C.rounded(F.col("overlap"), 9))


@query(
    "retention_by_degree_quartile",
    uses="registered",
    more=f"""e AS (SELECT * FROM (SELECT year * 4 + quarter - 1 AS p, user_id, count(DISTINCT article_id) AS x
      FROM registered GROUP BY 1, 2) WHERE x > 1),
    c AS (SELECT p, quantile_cont(x::DOUBLE, 0.25) AS a, quantile_cont(x::DOUBLE, 0.5) AS b, quantile_cont(x::DOUBLE, 0.75) AS c
      FROM e GROUP BY 1),
    placed AS (SELECT c.p, lag, user_id, CASE WHEN x <= a THEN 1 WHEN x <= b THEN 2 WHEN x <= c THEN 3 ELSE 4 END AS bucket
      FROM c JOIN (VALUES (0), (1)) l(lag) ON true JOIN e ON e.p = c.p + lag), {QUARTILE_TAIL}""",
    sql=QUARTILE_SELECT,
)
def retention_by_degree_quartile(spark, folder):
    return R.retention_by_degree(quarter_user_edges(spark, folder)).withColumn("overlap", C.rounded(F.col("overlap"), 9))


@query(
    "clique_sizes",
    uses="monthly",
    more=MONTHLY_CLIQUES,
    sql="SELECT article_id, edit_date, n_users, clique_edges FROM cl",
)
def clique_sizes(spark, folder):
    return D.clique_sizes(monthly_bipartite(spark, folder))


@query(
    "clique_size_dist",
    uses="monthly",
    more=MONTHLY_CLIQUES,
    sql="""SELECT n_users, count(*) AS n_cliques, CAST(sum(clique_edges) AS BIGINT) AS clique_edges FROM cl GROUP BY 1""",
)
def clique_size_dist(spark, folder):
    return D.clique_size_distribution(D.clique_sizes(monthly_bipartite(spark, folder)))


@query(
    "clique_edge_totals",
    uses="monthly",
    more=MONTHLY_CLIQUES,
    sql="""SELECT count(*) AS cliques, CAST(sum(n_users) AS BIGINT) AS memberships, CAST(sum(clique_edges) AS BIGINT) AS edges,
      CAST(sum(CASE WHEN clique_edges <= 6 THEN clique_edges ELSE 0 END) AS BIGINT) AS small_edges FROM cl""",
)
def clique_edge_totals(spark, folder):
    return D.clique_edge_totals(D.clique_sizes(monthly_bipartite(spark, folder)))


@query(
    "clique_percentiles",
    uses="monthly",
    more=f"""{MONTHLY_CLIQUES}, long AS (SELECT 'n_users' AS measure, n_users AS x FROM cl
      UNION ALL SELECT 'clique_edges', clique_edges FROM cl),
    agg AS (SELECT measure, min(x)::DOUBLE AS smallest, max(x)::DOUBLE AS largest,
      unnest({FRACTIONS}::DOUBLE[]) AS fraction, unnest(quantile_cont(x::DOUBLE, {FRACTIONS})) AS value
      FROM long GROUP BY measure)""",
    sql="SELECT measure, smallest, largest, fraction, round(value, 6) AS value FROM agg",
)
def clique_percentiles(spark, folder):
    rows = D.percentile_columns(D.clique_sizes(monthly_bipartite(spark, folder)), ["n_users", "clique_edges"], FRACTIONS)
    return rows.withColumn("value", C.rounded(F.col("value")))


@query(
    "first_author_percentiles",
    uses="human",
    more="""ranked AS (SELECT rank() OVER (PARTITION BY article_id ORDER BY "timestamp") AS article_rank,
      rank() OVER (PARTITION BY user_id ORDER BY "timestamp") AS user_rank FROM human)""",
    sql="""SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS fraction,
      unnest(list_transform(quantile_cont(user_rank::DOUBLE, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),
      lambda x: round(x, 6))) AS value FROM ranked WHERE article_rank = 1""",
)
def first_author_percentiles(spark, folder):
    fractions = [i / 10 for i in range(1, 10)]
    first = E.creation_ranks(human(spark, folder))
    rows = D.percentile_columns(first, ["user_rank"], fractions)
    return rows.select("fraction", C.rounded(F.col("value")).alias("value"))


USER_STATS = """us AS (SELECT user_id, count(DISTINCT article_id) AS n_articles, count(DISTINCT edit_date) AS n_edits,
  sum(word_count) AS contribution FROM bipartite GROUP BY 1)"""


def user_stats(spark, folder):
    return B.user_activity(B.bipartite_edges(plain_edits(spark, folder)))


@query(
    "user_activity",
    uses="bipartite",
    more=USER_STATS,
    sql="SELECT user_id, n_articles, n_edits, round(contribution, 6) AS contribution FROM us",
)
def user_activity(spark, folder):
    return user_stats(spark, folder).withColumn("contribution", C.rounded(F.col("contribution")))


@query(
    "group_activity_summary",
    uses="registered",
    more="""admin_names AS (SELECT c_name AS username, true AS is_admin FROM customer WHERE c_custkey % 40 = 1),
    tagged AS (SELECT unnest(list_filter([CASE WHEN true THEN 'all' END, CASE WHEN is_admin THEN 'admins' END,
      CASE WHEN lower(username) LIKE '%bot%' THEN 'bots' END], lambda x: x IS NOT NULL)) AS grp, user_id, article_id, textdata
      FROM registered LEFT JOIN admin_names USING (username)),
    per AS (SELECT grp, user_id, count(DISTINCT article_id) AS a, sum(ln(nullif(textdata, 0))) AS w FROM tagged GROUP BY 1, 2)""",
    sql="""SELECT grp, round(avg(a), 6) AS avg_n_articles, round(avg(w), 6) AS avg_sumlog_textdata,
      round(stddev_pop(a), 6) AS std_n_articles, round(stddev_pop(w), 6) AS std_sumlog_textdata, count(*) AS n_samples
    FROM per GROUP BY 1""",
)
def group_activity_summary(spark, folder):
    rows = E.registered_edits(W.edits(spark, folder))
    names = W.admins(spark, folder).select("username", F.lit(True).alias("is_admin"))
    per_user = (
        rows.groupBy("user_id", "username", "article_id")
        .agg(F.sum(F.log("textdata")).alias("words"))
        .groupBy("user_id", "username")
        .agg(F.count(F.lit(1)).alias("n_articles"), F.sum("words").alias("sumlog_textdata"))
        .join(names, "username", "left")
    )
    groups = F.filter(
        F.array(
            F.lit("all"),
            F.when(F.col("is_admin"), F.lit("admins")),
            F.when(C.is_bot(F.col("username")), F.lit("bots")),
        ),
        lambda g: g.isNotNull(),
    )
    return (
        per_user.withColumn("grp", F.explode(groups))
        .groupBy("grp")
        .agg(
            C.rounded(F.avg("n_articles")).alias("avg_n_articles"),
            C.rounded(F.avg("sumlog_textdata")).alias("avg_sumlog_textdata"),
            C.rounded(F.stddev_pop("n_articles")).alias("std_n_articles"),
            C.rounded(F.stddev_pop("sumlog_textdata")).alias("std_sumlog_textdata"),
            F.count(F.lit(1)).alias("n_samples"),
        )
    )


DEGREES = "deg AS (SELECT e1 AS node, count(*) AS degree FROM ways GROUP BY 1)"


@query(
    "degree_summary",
    uses="ways admins",
    more=f"""{DEGREES}, tagged AS (SELECT 'sample' AS grp, degree FROM deg WHERE {uniform('node')} < 0.1
      UNION ALL SELECT 'admins', degree FROM deg JOIN admins ON node = user_id),
    s AS (SELECT grp, avg(degree) AS mean, stddev_pop(degree) AS deviation, quantile_cont(degree::DOUBLE, 0.5) AS median,
      count(*) AS n_samples FROM tagged GROUP BY 1)""",
    sql="""SELECT grp, round(mean, 6) AS mean, round(deviation, 6) AS deviation, median, n_samples,
      round(deviation * 1.96 / sqrt(n_samples), 6) AS error_bound FROM s""",
)
def degree_summary(spark, folder):
    degrees = D.node_degrees(network(spark, folder))
    sample = E.hashed_sample(degrees, 0.1, "node").select(F.lit("sample").alias("grp"), "degree")
    admins = degrees.join(W.admins(spark, folder), F.col("node") == F.col("user_id"))
    rows = D.summary_with_bound(sample.union(admins.select(F.lit("admins"), "degree")), "degree", ["grp"])
    return rows.select(
        "grp", "median", "n_samples", *[C.rounded(F.col(c)).alias(c) for c in ("mean", "deviation", "error_bound")]
    )


@query(
    "describe_columns",
    uses="edits",
    sql="""SELECT count(*) AS n, round(avg(textdata), 6) AS mean_textdata, round(stddev_samp(textdata), 6) AS sd_textdata,
      min(textdata) AS min_textdata, max(textdata) AS max_textdata, min(article_id) AS min_article,
      max(article_id) AS max_article, count(*) FILTER (WHERE user_id IS NULL) AS null_users FROM edits""",
)
def describe_columns(spark, folder):
    return plain_edits(spark, folder).agg(
        F.count(F.lit(1)).alias("n"),
        C.rounded(F.avg("textdata")).alias("mean_textdata"),
        C.rounded(F.stddev("textdata")).alias("sd_textdata"),
        F.min("textdata").alias("min_textdata"),
        F.max("textdata").alias("max_textdata"),
        F.min("article_id").alias("min_article"),
        F.max("article_id").alias("max_article"),
        F.count_if(F.col("user_id").isNull()).alias("null_users"),
    )


@query(
    "projection_degrees",
    uses="ways",
    more=DEGREES,
    sql="SELECT degree, count(*) AS n_users FROM deg GROUP BY 1",
)
def projection_degrees(spark, folder):
    edges = P.user_network(B.memberships(plain_edits(spark, folder)))
    return D.node_degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("n_users"))


@query(
    "bipartite_vs_projection_degrees",
    uses="ways registered",
    more=f"""{DEGREES}, bd AS (SELECT user_id, count(DISTINCT article_id) AS degree FROM registered GROUP BY 1)""",
    sql="""SELECT 'projection' AS graph, degree, count(*) AS n_users FROM deg GROUP BY 2
    UNION ALL SELECT 'bipartite', degree, count(*) FROM bd GROUP BY 2""",
)
def bipartite_vs_projection_degrees(spark, folder):
    rows = E.registered_edits(plain_edits(spark, folder))
    own = B.degrees(rows).select(F.lit("bipartite").alias("graph"), "degree")
    edges = P.user_network(B.memberships(plain_edits(spark, folder)))
    both = D.node_degrees(edges).select(F.lit("projection").alias("graph"), "degree").union(own)
    return both.groupBy("graph", "degree").agg(F.count(F.lit(1)).alias("n_users"))


@query(
    "linear_fit",
    uses="ways bipartite",
    more=f"""{USER_STATS}, {DEGREES}, logs AS (SELECT ln(contribution + 1) AS x, ln(n_articles + 1) AS y, ln(n_edits + 1) AS z,
      contribution, degree FROM us LEFT JOIN deg ON user_id = node WHERE contribution <> 0),
    long AS (SELECT 'articles' AS pair, x, y FROM logs UNION ALL SELECT 'edits', x, z FROM logs
      UNION ALL SELECT 'degree', degree, contribution FROM logs WHERE degree IS NOT NULL)""",
    sql="""SELECT pair, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept,
      round(regr_r2(y, x), 6) AS r2, CAST(regr_count(y, x) AS BIGINT) AS n FROM long GROUP BY 1""",
)
def linear_fit(spark, folder):
    edges = P.user_network(B.memberships(plain_edits(spark, folder)))
    rows = user_stats(spark, folder).filter(F.col("contribution") != 0)
    rows = rows.join(D.node_degrees(edges), F.col("user_id") == F.col("node"), "left")
    x = F.log(F.col("contribution") + 1)
    fits = D.linear_fits(
        rows,
        {
            "articles": (x, F.log(F.col("n_articles") + 1)),
            "edits": (x, F.log(F.col("n_edits") + 1)),
            "degree": (F.col("degree").cast("double"), F.col("contribution")),
        },
    )
    return fits.select("pair", "n", *[C.rounded(F.col(c)).alias(c) for c in ("slope", "intercept", "r2")])


def sql_bin(value: str, low: str, high: str, bins: int) -> str:
    return (
        f"CAST(CASE WHEN ({high}) > ({low}) THEN least(floor(({value} - ({low})) / ((({high}) - ({low})) / {bins})), "
        f"{bins - 1}) ELSE 0 END AS INT)"
    )


@query(
    "density_grid",
    uses="bipartite",
    more=f"""{USER_STATS}, logs AS (SELECT round(ln(contribution + 1), 9) AS x, round(ln(n_articles + 1), 9) AS y FROM us
      WHERE contribution <> 0), lim AS (SELECT min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM logs)""",
    sql=f"""SELECT {sql_bin('x', 'xl', 'xh', 50)} AS x_bin, {sql_bin('y', 'yl', 'yh', 50)} AS y_bin, count(*) AS n
    FROM logs, lim GROUP BY 1, 2""",
)
def density_grid(spark, folder):
    rows = user_stats(spark, folder).filter(F.col("contribution") != 0)
    logs = rows.select(
        C.rounded(F.log(F.col("contribution") + 1), 9).alias("x"), C.rounded(F.log(F.col("n_articles") + 1), 9).alias("y")
    )
    return D.density_grid(logs, "x", "y")


@query(
    "log_histogram",
    uses="edits",
    more=f"""{PERIOD_DEGREES}, logs AS (SELECT period, round(ln(degree), 9) AS x, ln(n_users) AS w FROM pd),
    lim AS (SELECT min(x) AS lo, max(x) AS hi FROM logs)""",
    sql=f"""SELECT period, {sql_bin('x', 'lo', 'hi', 30)} AS bin, round(sum(w), 6) AS total
    FROM logs, lim GROUP BY 1, 2""",
)
def log_histogram(spark, folder):
    logs = period_degrees(spark, folder).select("period", C.rounded(F.log("degree"), 9).alias("x"), F.log("n_users").alias("w"))
    rows = D.histogram(logs, "x", 30, weight=F.col("w"), by=["period"])
    return rows.withColumn("total", C.rounded(F.col("total")))


@query(
    "kernel_density",
    uses="edits",
    more=f"""{PERIOD_DEGREES}, grid AS (SELECT CAST(range AS INT) AS point, 1.0 + range * (9.0 / 999) AS x FROM range(1000))""",
    sql=f"""SELECT period, point, round(avg(exp(-0.5 * pow((x - n_users) / 0.5, 2)) / (0.5 * {math.sqrt(2 * math.pi)})), 9)
      AS density FROM pd, grid GROUP BY 1, 2""",
)
def kernel_density(spark, folder):
    rows = D.kernel_density(period_degrees(spark, folder), "n_users", ["period"])
    return rows.withColumn("density", C.rounded(F.col("density"), 9))


@query(
    "powerlaw_fit",
    uses="monthly",
    more=f"""{MONTHLY_CLIQUES}, s AS (SELECT n_users FROM cl WHERE {uniform('article_id', 'edit_date')} < 0.1),
    lim AS (SELECT min(n_users) - 1 AS loc, max(n_users) - min(n_users) + 1 AS scale FROM s)""",
    sql="""SELECT round(-count(*) / sum(ln((n_users - loc) / scale)), 6) AS a, loc, scale, count(*) AS n FROM s, lim
    GROUP BY loc, scale""",
)
def powerlaw_fit(spark, folder):
    sample = E.hashed_sample(D.clique_sizes(monthly_bipartite(spark, folder)), 0.1, "article_id", "edit_date")
    return D.powerlaw_fit(sample, "n_users").withColumn("a", C.rounded(F.col("a")))
