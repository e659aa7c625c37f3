"""Structural roles."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillnet.functions import columns as C
from quillnet.operators import bipartite as B
from quillnet.operators import communities as K
from quillnet.operators import edits as E
from quillnet.operators import graph as G
from quillnet.operators import roles as R
from quillnet.plans.community_plans import bipartite
from quillnet.plans.feature_plans import rounded_columns
from quillnet.plans.projection_plans import network, plain_edits
from quillnet.plans.registry import query
from quillnet.session import cut_lineage
from quillnet.sources import warehouse as W

WIDTH = 64
PARTS = 16
DRAWN_RANKS = 8
SEED = 7
KNOWN_ROLES = range(8)
FEATURE_COLUMNS = [f"f{i}" for i in range(27)]
AT = "vec[{i}]"
MEAN_AT = "avg(vec[{i}])"
SCALED_MEAN_AT = "avg(vec[{i}] / list_sum(vec) * weight)"


def spread(df, column, prefix, width=WIDTH):
    """A vector column as rounded scalar columns."""
    entries = [C.rounded(F.element_at(column, i + 1)).alias(f"{prefix}{i}") for i in range(width)]
    return df.select(*[c for c in df.columns if c != column], *entries)


def sql_positions(template: str, prefix: str) -> str:
    return ", ".join(f"round({template.format(i=i + 1)}, 6) AS {prefix}{i}" for i in range(WIDTH))


ROLE_NAMES = [(-1, "role_none"), *[(r, f"role_{r}") for r in KNOWN_ROLES]]
MIX = f"""tagged AS (SELECT b.user_id, article_id, edit_date, coalesce(role_id, -1) AS role_id FROM bipartite b
  LEFT JOIN roles USING (user_id)),
shares AS (SELECT article_id, edit_date, {', '.join(f'count(*) FILTER (WHERE role_id = {r}) / count(*) AS {n}' for r, n in ROLE_NAMES)}
  FROM tagged GROUP BY 1, 2),
mixed AS (SELECT user_id, {', '.join(f'sum({n}) AS {n}' for _, n in ROLE_NAMES)} FROM bipartite
  JOIN shares USING (article_id, edit_date) GROUP BY 1)"""


@query(
    "article_role_mix",
    uses="bipartite roles",
    more=MIX,
    sql=f"""SELECT user_id, {', '.join(f"round({n} / ({' + '.join(m for _, m in ROLE_NAMES)}), 6) AS {n}" for _, n in ROLE_NAMES)}
    FROM mixed""",
)
def article_role_mix(spark, folder):
    return rounded_columns(R.article_role_mix(bipartite(spark, folder), W.role_labels(spark, folder), KNOWN_ROLES))


@query(
    "article_role_mix_by_column",
    uses="bipartite roles",
    more=MIX,
    sql=f"""SELECT user_id, {', '.join(f'round({n} / nullif(sum({n}) OVER (), 0), 9) AS {n}' for _, n in ROLE_NAMES)} FROM mixed""",
)
def article_role_mix_by_column(spark, folder):
    rows = R.article_role_mix(bipartite(spark, folder), W.role_labels(spark, folder), KNOWN_ROLES, by_column=True)
    return rounded_columns(rows, 9)


@query(
    "role_summary",
    uses="registered vectors admins",
    more="""us AS (SELECT user_id, count(DISTINCT article_id) AS n_articles, count(*) AS n_edits, sum(ln(textdata + 1)) AS edit_count
      FROM registered GROUP BY 1), lab AS (SELECT user_id, CAST(list_position(vec, list_max(vec)) - 1 AS INT) AS label FROM vectors)""",
    sql="""SELECT label, count(*) AS n_users, count(a.user_id) AS n_admins, round(avg(n_articles), 6) AS avg_n_articles,
      round(stddev_samp(n_articles), 6) AS sd_n_articles, round(avg(n_edits), 6) AS avg_n_edits,
      round(stddev_samp(n_edits), 6) AS sd_n_edits, round(avg(edit_count), 6) AS avg_edit_count,
      round(stddev_samp(edit_count), 6) AS sd_edit_count, round(count(a.user_id) / count(*), 6) AS pct_admin
    FROM us JOIN lab USING (user_id) LEFT JOIN admins a USING (user_id) GROUP BY 1""",
)
def role_summary(spark, folder):
    summary = K.user_summary(E.registered_edits(plain_edits(spark, folder))).select(
        "user_id", "n_articles", "n_edits", F.col("sum_log_words").alias("edit_count")
    )
    return rounded_columns(R.role_summary(summary, W.role_vectors(spark, folder), W.admins(spark, folder)))


@query(
    "role_admin_counts",
    uses="roles admins",
    sql="""SELECT role_id, count(*) AS n_users, count(a.user_id) AS n_admins FROM roles LEFT JOIN admins a USING (user_id)
    GROUP BY 1""",
)
def role_admin_counts(spark, folder):
    return R.role_admin_counts(W.role_labels(spark, folder), W.admins(spark, folder))


@query(
    "role_range", uses="roles", sql="SELECT min(role_id) AS lowest, max(role_id) AS highest FROM roles"
)
def role_range(spark, folder):
    return W.role_labels(spark, folder).agg(F.min("role_id").alias("lowest"), F.max("role_id").alias("highest"))


@query(
    "neighbour_role_mean",
    uses="ways vectors",
    sql=f"""SELECT e1 AS user_id, {sql_positions(MEAN_AT, 'r')} FROM ways JOIN vectors ON e2 = user_id GROUP BY 1""",
)
def neighbour_role_mean(spark, folder):
    rows = R.neighbour_role_mean(network(spark, folder), W.role_vectors(spark, folder), WIDTH)
    return spread(rows, "neighbour_vec", "r")


@query(
    "neighbour_role_mean_weighted",
    uses="ways vectors",
    sql=f"""SELECT e1 AS user_id, {sql_positions(SCALED_MEAN_AT, 'r')} FROM ways
    JOIN vectors ON e2 = user_id GROUP BY 1""",
)
def neighbour_role_mean_weighted(spark, folder):
    rows = R.neighbour_role_mean(network(spark, folder), W.role_vectors(spark, folder), WIDTH, weighted=True)
    return spread(rows, "neighbour_vec", "r")


LEFT_OUT = "(sum(vec[{i}]) OVER () - vec[{i}]) / (count(*) OVER () - 1) * (vec[{i}] / list_sum(vec))"


@query(
    "leave_self_out_role_mean",
    uses="ways vectors",
    more=f"""nb AS (SELECT e1 AS user_id, {sql_positions(MEAN_AT, 'n')} FROM ways
      JOIN vectors ON e2 = user_id GROUP BY 1),
    lo AS (SELECT user_id, {sql_positions(LEFT_OUT, 't')}, {sql_positions(AT, 'v')} FROM vectors)""",
    sql="SELECT * FROM nb JOIN lo USING (user_id)",
)
def leave_self_out_role_mean(spark, folder):
    vectors = W.role_vectors(spark, folder)
    around = spread(R.neighbour_role_mean(network(spark, folder), vectors, WIDTH), "neighbour_vec", "n")
    own = spread(spread(R.leave_self_out_role_mean(vectors, WIDTH), "other_vec", "t"), "vec", "v")
    return around.join(own, "user_id")


@query(
    "community_role_mean",
    uses="vectors user_comms",
    more=f"""m AS (SELECT community_id, count(*) AS size, {', '.join(f'avg(vec[{i + 1}]) AS a{i}' for i in range(WIDTH))}
      FROM vectors LEFT JOIN user_comms USING (user_id) GROUP BY 1)""",
    sql=f"""SELECT community_id, size,
      {', '.join(f"round(a{i} / ({' + '.join(f'a{j}' for j in range(WIDTH))}), 6) AS r{i}" for i in range(WIDTH))} FROM m""",
)
def community_role_mean(spark, folder):
    rows = R.community_role_mean(W.role_vectors(spark, folder), W.user_communities(spark, folder), WIDTH)
    return spread(rows, "mean_vec", "r")


COSINE = """anchor AS (SELECT vec AS a FROM vectors ORDER BY user_id LIMIT 1),
sims AS (SELECT user_id, list_dot_product(vec, a) / sqrt(list_dot_product(vec, vec)) / sqrt(list_dot_product(a, a)) AS s
  FROM vectors, anchor)"""


@query("role_similarity", uses="vectors", more=COSINE, sql="SELECT user_id, round(s, 6) AS similarity FROM sims")
def role_similarity(spark, folder):
    return rounded_columns(R.role_similarity(W.role_vectors(spark, folder)))


@query(
    "role_similarity_histogram",
    uses="vectors",
    more=COSINE,
    sql="SELECT CAST(least(floor(round(s, 9) / (1.0::DOUBLE / 50)), 49) AS INT) AS bin, count(*) AS n FROM sims GROUP BY 1",
)
def role_similarity_histogram(spark, folder):
    return R.similarity_histogram(rounded_columns(R.role_similarity(W.role_vectors(spark, folder)), 9))


@query(
    "role_one_hot",
    uses="members roles",
    sql=f"""SELECT user_id, {', '.join(f'CAST(coalesce(role_id, -1) = {r} AS INT) AS {n}' for r, n in ROLE_NAMES)}
    FROM (SELECT DISTINCT user_id FROM members) LEFT JOIN roles USING (user_id)""",
)
def role_one_hot(spark, folder):
    users = B.memberships(plain_edits(spark, folder)).select("user_id").distinct()
    return R.role_one_hot(users, W.role_labels(spark, folder), KNOWN_ROLES)


def mined(spark, folder):
    """Recursive features of the user network on a log scale, as vectors."""
    features = G.recursive_features(network(spark, folder), 2)
    logs = features.select("node", *[F.log1p(F.col(c)).alias(c) for c in FEATURE_COLUMNS])
    return R.as_vectors(logs, FEATURE_COLUMNS)


@query("mine_roles")
def mine_roles(spark, folder):
    features = G.recursive_features(network(spark, folder), 2)
    binned = R.log_binned(features, FEATURE_COLUMNS)
    kept = R.uncorrelated_columns(binned, FEATURE_COLUMNS)
    return R.as_vectors(binned, kept)


@query("factor_roles")
def factor_roles(spark, folder):
    vectors, _, _ = R.factor_roles(mined(spark, folder), len(FEATURE_COLUMNS), parts=PARTS)
    return spread(vectors, "vec", "g", PARTS)


@query(
    "factor_error",
    uses="vectors",
    more=f"""cells AS (SELECT user_id, unnest(vec) AS v, unnest(range(1, {WIDTH + 1})) AS j FROM vectors),
    fits AS (SELECT v, sum(v) OVER (PARTITION BY user_id) * sum(v) OVER (PARTITION BY j) / sum(v) OVER () AS p FROM cells),
    sums AS (SELECT count(*) / {WIDTH} AS n, sum(CASE WHEN v > 0 AND p > 0 THEN v * ln(v / p) - v + p END) AS d FROM fits)""",
    sql=f"""SELECT 64 * {WIDTH} * (n + {WIDTH}) AS model_bits, round(d, 6) AS divergence,
      round(64 * {WIDTH} * (n + {WIDTH}) + d, 6) AS description_length FROM sums""",
)
def factor_error(spark, folder):
    fits = R.rank_one_fit(W.role_vectors(spark, folder), WIDTH)
    return rounded_columns(R.description_length(fits, WIDTH))


@query("rank_search")
def rank_search(spark, folder):
    ranks = sorted(random.Random(SEED).sample(range(1, 64), DRAWN_RANKS))
    return R.rank_search(cut_lineage(W.role_vectors(spark, folder)), WIDTH, ranks)


@query("role_pca")
def role_pca(spark, folder):
    scores, _ = R.role_pca(mined(spark, folder), len(FEATURE_COLUMNS))
    return scores.withColumn("components", F.transform("components", lambda x: F.round(x, 6)))


@query("role_sense")
def role_sense(spark, folder):
    summary = K.user_summary(E.registered_edits(plain_edits(spark, folder)))
    rows = summary.select("user_id", "n_articles", "n_edits", F.col("sum_log_words").alias("edit_count"))
    rows = rows.join(W.role_vectors(spark, folder), "user_id")
    return rounded_columns(R.role_sense(rows, ["n_articles", "n_edits", "edit_count"], WIDTH))


@query("role_affinity")
def role_affinity(spark, folder):
    return rounded_columns(R.role_affinity(network(spark, folder), W.role_vectors(spark, folder), WIDTH))
