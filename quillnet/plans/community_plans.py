"""Community measures, features and detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillnet.functions import columns as C
from quillnet.operators import bipartite as B
from quillnet.operators import communities as K
from quillnet.operators import edits as E
from quillnet.operators import louvain as L
from quillnet.operators import projection as P
from quillnet.operators.skew import ordered_index
from quillnet.plans.distribution_plans import human
from quillnet.plans.feature_plans import rounded_columns
from quillnet.plans.projection_plans import network, plain_edits
from quillnet.plans.registry import query
from quillnet.plans.views import per_measure, rounded
from quillnet.session import scratch_path
from quillnet.sources import warehouse as W


def bipartite(spark, folder):
    return B.bipartite_edges(plain_edits(spark, folder))


def quarter_contributions(human_edits):
    """Label-window contribution per user, zero when absent."""
    labels = E.next_period_contribution(human_edits)
    return E.first_quarters(human_edits).join(labels, "user_id", "left").select(
        F.col("user_id").cast("bigint").alias("user_id"), F.coalesce("contrib", F.lit(0.0)).alias("contrib")
    )


def members(spark, folder):
    return K.members_with_contribution(W.user_communities(spark, folder), quarter_contributions(human(spark, folder)))


@query(
    "community_density",
    uses="ways user_comms",
    more="""cs AS (SELECT community_id, count(*) AS edges, count(DISTINCT e1) AS size FROM user_comms JOIN ways
      ON user_id = e1 GROUP BY 1)""",
    sql="""SELECT community_id, edges, size, round(edges / greatest(size * (size - 1), 1), 6) AS density FROM cs""",
)
def community_density(spark, folder):
    edges = P.user_network(B.memberships(plain_edits(spark, folder)))
    return rounded_columns(K.community_density(edges, W.user_communities(spark, folder)))


@query(
    "community_sizes",
    uses="user_comms article_comms",
    sql="""SELECT community_id, cat, count(*) AS members FROM (SELECT community_id, 'users' AS cat FROM user_comms
      UNION ALL SELECT community_id, 'articles' FROM article_comms) GROUP BY 1, 2""",
)
def community_sizes(spark, folder):
    return K.community_sizes(
        {"users": W.user_communities(spark, folder), "articles": W.article_communities(spark, folder)}
    )


# What a user gave in a quarter; quarters are dates, told apart by year and number only in the results.
EFFORTS = """efforts AS (SELECT user_id, date_trunc('quarter', edit_date) AS q, ln(1 + sum(ln(1 + word_count))) AS effort
  FROM bipartite GROUP BY user_id, q)"""
WHEN = "year(q)::INT AS year, quarter(q)::INT AS quarter"


@query(
    "user_contribution",
    uses="bipartite",
    more=EFFORTS,
    sql=f"SELECT user_id, {WHEN}, round(effort, 6) AS yval FROM efforts",
)
def user_contribution(spark, folder):
    return rounded_columns(K.user_contribution(bipartite(spark, folder)))


STANDING_STEPS = f"""placed AS (SELECT * FROM efforts JOIN user_comms USING (user_id)),
standing AS ({per_measure('placed', 'community_id', {'mean_effort': 'avg(effort)', 'efforts_held': 'count(*)'})})"""
STANDING = f"{EFFORTS}, {STANDING_STEPS}"


@query(
    "community_window_mean",
    uses="bipartite user_comms",
    more=STANDING,
    sql=f"""SELECT user_id, {WHEN}, community_id, round(effort, 6) AS yval, round(mean_effort, 6) AS avg_yval,
      efforts_held AS c_size FROM placed JOIN standing USING (community_id)""",
)
def community_window_mean(spark, folder):
    contributions = K.user_contribution(bipartite(spark, folder))
    return rounded_columns(K.assigned(contributions, W.user_communities(spark, folder)))


@query(
    "user_community_features",
    uses="bipartite user_comms",
    more=STANDING,
    sql="""SELECT DISTINCT user_id, round(mean_effort, 6) AS avg_yval, efforts_held AS c_size
      FROM user_comms JOIN standing USING (community_id) WHERE user_id IN (SELECT user_id FROM efforts)""",
)
def user_community_features(spark, folder):
    contributions = K.user_contribution(bipartite(spark, folder))
    return rounded_columns(K.user_community_features(contributions, W.user_communities(spark, folder)))


@query(
    "first_period_row",
    uses="bipartite",
    more=EFFORTS,
    sql=f"""SELECT user_id, {WHEN}, round(effort, 6) AS yval FROM efforts e
      WHERE NOT EXISTS (SELECT 1 FROM efforts o WHERE o.user_id = e.user_id AND o.q < e.q)""",
)
def first_period_row(spark, folder):
    return rounded_columns(K.first_period_row(K.user_contribution(bipartite(spark, folder)), ["yval"]))


# A contributor's effort of the quarter counts once for every day on the article.
DRAWN_STEPS = f"""days AS (SELECT article_id, b.user_id, e.q, effort FROM bipartite b, efforts e
  WHERE b.user_id = e.user_id AND b.edit_date >= e.q AND b.edit_date < e.q + INTERVAL 3 MONTH),
drawn AS ({per_measure('days', 'article_id, q', {'effort_sum': 'sum(effort)', 'effort_days': 'count(*)'})})"""
DRAWN = f"{EFFORTS}, {DRAWN_STEPS}"


@query(
    "article_contribution",
    uses="bipartite",
    more=DRAWN,
    sql=f"SELECT article_id, {WHEN}, round(effort_sum, 6) AS sum_yval, effort_days AS num FROM drawn",
)
def article_contribution(spark, folder):
    return rounded_columns(K.article_contribution(bipartite(spark, folder)))


POOL_STEPS = f"""pool AS (SELECT * FROM drawn JOIN article_comms USING (article_id)),
pooled AS ({per_measure('pool', 'community_id', {'pool_mean': 'sum(effort_sum) / sum(effort_days)', 'pool_size': 'count(*)'})})"""
POOLED = f"{DRAWN}, {POOL_STEPS}"


@query(
    "community_weighted_mean",
    uses="bipartite article_comms",
    more=POOLED,
    sql=f"""SELECT article_id, {WHEN}, community_id, round(pool_mean, 6) AS avg_yval, pool_size AS c_size,
      round(effort_sum / effort_days, 6) AS self_yval, effort_days AS self_csize FROM pool JOIN pooled USING (community_id)""",
)
def community_weighted_mean(spark, folder):
    contributions = K.article_contribution(bipartite(spark, folder))
    return rounded_columns(K.article_community_values(contributions, W.article_communities(spark, folder)))


MET_STEPS = f"""{DRAWN_STEPS}, {POOL_STEPS}, met AS (SELECT days.user_id, days.q, pool_mean, pool_size, effort_sum / effort_days AS alone, effort_days
  FROM days JOIN pool USING (article_id, q) JOIN pooled USING (community_id)),
opening_days AS (SELECT * FROM met m WHERE q = (SELECT min(q) FROM met o WHERE o.user_id = m.user_id))"""
MET = f"{EFFORTS}, {MET_STEPS}"
MET_MEANS = {
    "avg_yval": "round(avg(pool_mean), 6)",
    "avg_csize": "round(avg(pool_size), 6)",
    "avg_syval": "round(avg(alone), 6)",
    "avg_scsize": "round(avg(effort_days), 6)",
}


@query(
    "article_community_features",
    uses="bipartite article_comms",
    more=MET,
    sql=per_measure("opening_days", "user_id", MET_MEANS),
)
def article_community_features(spark, folder):
    return rounded_columns(K.article_community_features(bipartite(spark, folder), W.article_communities(spark, folder)))


PEOPLE = """people AS (SELECT c.user_id, community_id, coalesce(k.contrib, 0) AS given FROM user_comms c
  LEFT JOIN contribs k ON k.user_id = c.user_id::VARCHAR WHERE c.user_id::VARCHAR IN (SELECT user_id FROM human))"""
GIVEN = {"members": "count(*)", "sum_contrib": "sum(given)", "sum_lcontrib": "sum(ln(1 + given))"}


@query(
    "community_base",
    uses="human contribs user_comms",
    more=f"{PEOPLE}, given AS ({per_measure('people', 'community_id', GIVEN)})",
    sql=f"SELECT community_id AS c_id, members, {rounded(['sum_contrib', 'sum_lcontrib'])} FROM given",
)
def community_base(spark, folder):
    return rounded_columns(K.community_base(members(spark, folder)))


CROSSINGS = f"""{PEOPLE}, crossings AS (SELECT p.user_id, there.community_id, count(*) AS links FROM people p
  JOIN network n ON p.user_id IN (n.e1, n.e2) JOIN people there ON there.user_id = n.e1 + n.e2 - p.user_id
  WHERE there.community_id <> p.community_id GROUP BY p.user_id, there.community_id)"""


@query(
    "cross_community_links",
    uses="human contribs user_comms network",
    more=CROSSINGS,
    sql="SELECT user_id AS u_id, community_id AS c_id, links AS num FROM crossings",
)
def cross_community_links(spark, folder):
    return K.cross_community_links(network(spark, folder), members(spark, folder))


@query(
    "community_interactions",
    uses="human contribs user_comms network",
    more=f"""{CROSSINGS}, abroad AS (SELECT c.user_id, c.community_id, avg(given) AS mean, avg(ln(1 + given)) AS mean_log
      FROM crossings c JOIN people USING (community_id) GROUP BY c.user_id, c.community_id),
    home AS (SELECT p.user_id, avg(o.given) AS mean, avg(ln(1 + o.given)) AS mean_log FROM people p
      LEFT JOIN people o ON o.community_id = p.community_id AND o.user_id <> p.user_id GROUP BY p.user_id)""",
    sql="""SELECT user_id AS u_id, round(avg(a.mean), 6) AS avg_icontrib, round(avg(a.mean_log), 6) AS avg_licontrib,
      round(coalesce(any_value(h.mean), 0), 6) AS avg_contrib, round(coalesce(any_value(h.mean_log), 0), 6) AS avg_lcontrib
    FROM abroad a JOIN home h USING (user_id) GROUP BY user_id""",
)
def community_interactions(spark, folder):
    return rounded_columns(K.community_interactions(network(spark, folder), members(spark, folder)))


@query(
    "community_admin_summary",
    uses="registered admins user_comms",
    more="su AS (SELECT user_id, ln(sum(textdata) + 1) AS edit_count, count(*) AS n_edits FROM registered GROUP BY 1)",
    sql="""SELECT coalesce(community_id, -1) AS community_id, count(*) AS n_users, count(a.user_id) AS n_admins,
      round(sum(edit_count), 6) AS edit_count, CAST(sum(n_edits) AS BIGINT) AS n_edits
    FROM su LEFT JOIN admins a USING (user_id) LEFT JOIN user_comms USING (user_id) GROUP BY 1""",
)
def community_admin_summary(spark, folder):
    summary = K.user_summary(E.registered_edits(plain_edits(spark, folder)))
    communities = W.user_communities(spark, folder)
    return rounded_columns(K.community_admin_summary(summary, W.admins(spark, folder), communities))


@query(
    "community_map_join",
    uses="members",
    more="""packed AS (SELECT DISTINCT CAST(concat(quarter, year % 10, user_id) AS BIGINT) AS packed FROM members),
    labels AS (SELECT packed, rank() OVER (ORDER BY packed) AS dense_id FROM packed)""",
    sql="""SELECT CAST(left(packed::VARCHAR, 1) AS INT) AS quarter,
      CAST(CASE WHEN substr(packed::VARCHAR, 2, 1) >= '5' THEN concat('199', substr(packed::VARCHAR, 2, 1))
           ELSE concat('200', substr(packed::VARCHAR, 2, 1)) END AS INT) AS year,
      CAST(substr(packed::VARCHAR, 3) AS BIGINT) AS node_id, dense_id % 37 AS community_id FROM labels""",
)
def community_map_join(spark, folder):
    rows = B.memberships(plain_edits(spark, folder))
    packed = rows.select(C.pack_node_id(F.col("user_id"), F.col("year"), F.col("quarter")).alias("packed")).distinct()
    labels = ordered_index(packed, [], "packed", "dense_id", start=1)
    assignments = labels.select("dense_id", (F.col("dense_id") % 37).alias("community_id"))
    return K.unpacked_assignment(labels, assignments, decade=1995)


MODULARITY = """deg AS (SELECT e1 AS node, sum(weight) AS k FROM ways GROUP BY 1),
side AS (SELECT community_id AS c, sum(k) AS tot, count(*) AS size FROM deg JOIN user_comms ON node = user_id GROUP BY 1),
inn AS (SELECT a.community_id AS c, sum(weight) AS w FROM ways JOIN user_comms a ON e1 = a.user_id
  JOIN user_comms b ON e2 = b.user_id WHERE a.community_id = b.community_id GROUP BY 1),
tt AS (SELECT sum(tot)::DOUBLE AS m2, sum(size)::DOUBLE AS n FROM side)"""


@query(
    "modularity",
    uses="ways user_comms",
    more=MODULARITY,
    sql="""SELECT round(sum(coalesce(w, 0) / m2 - (tot / m2) * (tot / m2)), 9) AS modularity,
      round(sum(coalesce(w, 0) / m2 - 2 * size * tot / (n * m2) + (size / n) * (size / n)), 9) AS indeterminism
    FROM side LEFT JOIN inn USING (c), tt""",
)
def modularity(spark, folder):
    assignment = W.user_communities(spark, folder).withColumnRenamed("user_id", "node")
    return rounded_columns(K.modularity(network(spark, folder), assignment), 9)


@query("louvain")
def louvain(spark, folder):
    return L.louvain(network(spark, folder))


@query("louvain_di")
def louvain_di(spark, folder):
    return L.louvain(network(spark, folder), score=L.INDETERMINISM)


# A fixed hierarchy of three levels over the given communities.
COARSER = (1, 4, 16)


@query(
    "hierarchy_level",
    uses="user_comms",
    sql=f"SELECT user_id AS node, (community_id // {COARSER[1]})::BIGINT AS community_id FROM user_comms",
)
def hierarchy_level(spark, folder):
    """The middle level of a stored hierarchy, read without the others."""
    users = W.user_communities(spark, folder)
    path = scratch_path(spark, "hierarchy")
    for level, share in enumerate(COARSER):
        group = F.floor(F.col("community_id") / share).cast("bigint")
        L.append_level(users.select(F.col("user_id").alias("node"), group.alias("community_id")), level, path)
    return L.hierarchy_level(L.read_hierarchy(spark, path), 1)
