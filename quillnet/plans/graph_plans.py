"""Measures of the sampled user network."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillnet.functions import columns as C
from quillnet.operators import bipartite as B
from quillnet.operators import communities as K
from quillnet.operators import distributions as D
from quillnet.operators import edits as E
from quillnet.operators import graph as G
from quillnet.operators import projection as P
from quillnet.operators import traversal as T
from quillnet.plans.feature_plans import rounded_columns
from quillnet.plans.projection_plans import network, plain_edits
from quillnet.plans.registry import query
from quillnet.plans.views import uniform
from quillnet.sources import warehouse as W

PAGERANK_ROUNDS = 100
PAGERANK_TOLERANCE = 1e-4
# Rounds the oracles are unrolled to; they change nothing once a search has ended, or a vector has settled.
HITS_ROUNDS = 40
BFS_ROUNDS = 24
CORE_ROUNDS = 100


@query(
    "graph_size",
    uses="ways",
    sql="SELECT count(DISTINCT e1) AS nodes, count(*) // 2 AS edges FROM ways",
)
def graph_size(spark, folder):
    pairs = P.sampled_pairs(
        B.memberships(plain_edits(spark, folder)), ["article_id", "year", "quarter"], "user_id"
    )
    return G.graph_size(G.simple_edges(pairs))


@query(
    "graph_build",
    uses="ways",
    sql="SELECT e1 AS node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weight FROM ways GROUP BY 1",
)
def graph_build(spark, folder):
    vertices, _ = G.build_graph(network(spark, folder))
    return vertices


def pagerank_ctes(rounds: int, every: int, tolerance: float) -> str:
    """Rounds until the summed change, looked at every few rounds, is below the tolerance."""
    steps = ["deg AS (SELECT e1 AS node, count(*) AS d FROM ways GROUP BY 1)",
             "cnt AS (SELECT count(*)::DOUBLE AS n FROM deg)",
             "pr0 AS MATERIALIZED (SELECT node, d, 1 / n AS p FROM deg, cnt)"]
    for i in range(rounds):
        steps.append(
            f"pr{i + 1} AS MATERIALIZED (SELECT e2 AS node, x.d, 0.85 * sum(p / pr{i}.d) + 0.15 / any_value(n) AS p "
            f"FROM ways JOIN pr{i} ON e1 = pr{i}.node JOIN deg x ON e2 = x.node, cnt GROUP BY 1, 2)"
        )
    looks = range(every, rounds + 1, every)
    moved = " UNION ALL ".join(
        f"SELECT {k} AS step, sum(abs(a.p - b.p)) AS moved FROM pr{k} a JOIN pr{k - 1} b USING (node)" for k in looks
    )
    ranks = " UNION ALL ".join(f"SELECT {k} AS step, node, p FROM pr{k}" for k in looks)
    steps.append(f"stop AS (SELECT coalesce(min(step) FILTER (moved < {tolerance}), max(step)) AS step FROM ({moved}))")
    steps.append(f"settled AS (SELECT node, p FROM ({ranks}) JOIN stop USING (step))")
    return ", ".join(steps)


@query(
    "pagerank",
    uses="ways",
    more=pagerank_ctes(PAGERANK_ROUNDS, G.CUT_EVERY, PAGERANK_TOLERANCE),
    sql="SELECT node, round(p, 9) AS pagerank FROM settled",
)
def pagerank(spark, folder):
    return rounded_columns(G.pagerank(network(spark, folder), PAGERANK_ROUNDS, tolerance=PAGERANK_TOLERANCE), 9)


def hits_ctes(rounds: int) -> str:
    steps = ["v0 AS MATERIALIZED (SELECT e1 AS node, 1.0::DOUBLE AS x FROM ways GROUP BY 1)"]
    for i in range(2 * rounds):
        steps.append(
            f"v{i + 1} AS MATERIALIZED (SELECT e2 AS node, sum(x) / (SELECT max(x) FROM v{i}) AS x FROM ways JOIN v{i} "
            "ON e1 = node GROUP BY 1)"
        )
    return ", ".join(steps)


HITS_SELECT = f"""SELECT h.node, round(h.x / (SELECT sqrt(sum(x * x)) FROM v{2 * HITS_ROUNDS}), 6) AS hub,
  round(a.x / (SELECT sqrt(sum(x * x)) FROM v{2 * HITS_ROUNDS - 1}), 6) AS authority
FROM v{2 * HITS_ROUNDS} h JOIN v{2 * HITS_ROUNDS - 1} a USING (node)"""


@query("hits", uses="ways", more=hits_ctes(HITS_ROUNDS), sql=HITS_SELECT)
def hits(spark, folder):
    return rounded_columns(G.hits(network(spark, folder)))


def bfs_ctes(sources: str, rounds: int) -> str:
    """Unrolled breadth-first search: a neighbour of the last level is new unless it is in the last two."""
    steps = [f"s AS ({sources})", "b0 AS MATERIALIZED (SELECT node AS src, node FROM s)"]
    for i in range(rounds):
        known = f"SELECT src, node FROM b{i}" + (f" UNION ALL SELECT src, node FROM b{i - 1}" if i else "")
        steps.append(
            f"b{i + 1} AS MATERIALIZED (SELECT DISTINCT src, e2 AS node FROM b{i} JOIN ways ON node = e1 "
            f"WHERE (src, e2) NOT IN ({known}))"
        )
    every = " UNION ALL ".join(f"SELECT src, node, {i} AS level FROM b{i}" for i in range(rounds + 1))
    return ", ".join(steps) + f", bfs AS ({every})"


def brandes_ctes(rounds: int) -> str:
    """Shortest-path counts out level by level, dependencies back level by level."""
    steps = ["b0 AS MATERIALIZED (SELECT DISTINCT e1 AS src, e1 AS node, 1.0::DOUBLE AS sigma FROM ways)"]
    for i in range(rounds):
        known = f"SELECT src, node FROM b{i}" + (f" UNION ALL SELECT src, node FROM b{i - 1}" if i else "")
        steps.append(
            f"b{i + 1} AS MATERIALIZED (SELECT src, e2 AS node, sum(sigma) AS sigma FROM b{i} JOIN ways ON node = e1 "
            f"WHERE (src, e2) NOT IN ({known}) GROUP BY 1, 2)"
        )
    steps.append(f"d{rounds} AS MATERIALIZED (SELECT src, node, sigma, 0.0::DOUBLE AS delta FROM b{rounds})")
    for i in reversed(range(rounds)):
        steps.append(
            f"d{i} AS MATERIALIZED (SELECT u.src, u.node, u.sigma, coalesce(g.delta, 0.0) AS delta FROM b{i} u LEFT JOIN "
            f"(SELECT u.src, u.node, sum(u.sigma * (1 + l.delta) / l.sigma) AS delta FROM b{i} u JOIN ways ON u.node = e1 "
            f"JOIN d{i + 1} l ON l.src = u.src AND l.node = e2 GROUP BY 1, 2) g USING (src, node))"
        )
    every = " UNION ALL ".join(f"SELECT src, node, delta FROM d{i}" for i in range(rounds + 1))
    return ", ".join(steps) + f", deps AS ({every})"


@query(
    "betweenness",
    uses="ways",
    more=brandes_ctes(BFS_ROUNDS),
    sql="""SELECT node, round(sum(CASE WHEN src <> node THEN delta ELSE 0.0 END) / 2, 6) AS betweenness FROM deps
    GROUP BY 1""",
)
def betweenness(spark, folder):
    return rounded_columns(T.node_betweenness(network(spark, folder)))


EDGE_FLOWS = " UNION ALL ".join(
    f"""SELECT least(u.node, l.node) AS e1, greatest(u.node, l.node) AS e2, u.sigma * (1 + l.delta) / l.sigma AS flow
    FROM d{i} u JOIN ways w ON u.node = w.e1 JOIN d{i + 1} l ON l.src = u.src AND l.node = w.e2"""
    for i in range(BFS_ROUNDS)
)


@query(
    "edge_betweenness",
    uses="ways",
    more=brandes_ctes(BFS_ROUNDS),
    sql=f"SELECT e1, e2, round(sum(flow) / 2, 6) AS betweenness FROM ({EDGE_FLOWS}) GROUP BY 1, 2",
)
def edge_betweenness(spark, folder):
    return rounded_columns(T.edge_betweenness(network(spark, folder)))


@query(
    "eccentricity",
    uses="ways",
    more=bfs_ctes("SELECT DISTINCT e1 AS node FROM ways", BFS_ROUNDS),
    sql="SELECT src AS node, max(level) AS eccentricity FROM bfs GROUP BY 1",
)
def eccentricity(spark, folder):
    return T.eccentricities(network(spark, folder))


@query(
    "effective_diameter",
    uses="ways",
    more=bfs_ctes(
        f"SELECT node FROM (SELECT DISTINCT e1 AS node FROM ways) ORDER BY {uniform('node')}, node LIMIT 100", BFS_ROUNDS
    )
    + """, hops AS (SELECT level, count(*) AS pairs FROM bfs GROUP BY 1),
    cdf AS (SELECT level, sum(pairs) OVER (ORDER BY level) AS c, sum(pairs) OVER () AS total FROM hops),
    steps AS (SELECT level, c, lag(c) OVER (ORDER BY level) AS before, lag(level) OVER (ORDER BY level) AS prior, total FROM cdf),
    hit AS (SELECT * FROM steps WHERE c > 0.9 * total ORDER BY level LIMIT 1)""",
    sql="""SELECT round(CASE WHEN prior IS NULL THEN 1.0 ELSE prior + (0.9 * total - before) / (c - before) END, 9)
      AS effective_diameter, (SELECT max(level) FROM hops) AS diameter,
      round((SELECT sum(level * pairs) / sum(pairs) FROM hops), 9) AS average_path FROM hit""",
)
def effective_diameter(spark, folder):
    return rounded_columns(T.effective_diameter(network(spark, folder)), 9)


@query("sketched_diameter")
def sketched_diameter(spark, folder):
    """All nodes as sources, by sketches of 1,024 registers; tests hold it against exact searches."""
    return rounded_columns(T.sketched_diameter(network(spark, folder)), 9)


TRIANGLES = """deg AS (SELECT e1 AS node, count(*) AS degree FROM ways GROUP BY 1),
corners AS (SELECT a.e1 AS node, count(*) // 2 AS triangles FROM ways a JOIN ways b ON a.e2 = b.e1
  JOIN ways c ON b.e2 = c.e1 AND c.e2 = a.e1 GROUP BY 1),
clust AS (SELECT node, degree, coalesce(triangles, 0) AS triangles,
  CASE WHEN degree > 1 THEN coalesce(triangles, 0) / (degree * (degree - 1) / 2) ELSE 0.0 END AS clustering
  FROM deg LEFT JOIN corners USING (node))"""


@query(
    "clustering_coefficient",
    uses="ways",
    more=TRIANGLES,
    sql="SELECT node, degree, triangles, round(clustering, 9) AS clustering FROM clust",
)
def clustering_coefficient(spark, folder):
    return rounded_columns(G.clustering_coefficients(network(spark, folder)), 9)


@query(
    "average_clustering",
    uses="ways",
    more=TRIANGLES,
    sql="SELECT round(avg(clustering), 9) AS average_clustering, count(*) AS nodes FROM clust",
)
def average_clustering(spark, folder):
    return rounded_columns(G.average_clustering(network(spark, folder)), 9)


@query(
    "weighted_subgraph",
    uses="network",
    more=f"""ways AS (SELECT e1, e2 FROM network WHERE weight > 1 UNION ALL SELECT e2, e1 FROM network WHERE weight > 1),
    {TRIANGLES}""",
    sql="SELECT round(avg(clustering), 9) AS average_clustering, count(*) AS nodes FROM clust",
)
def weighted_subgraph(spark, folder):
    return rounded_columns(G.average_clustering(P.weight_threshold(network(spark, folder), 1, "weight")), 9)


@query(
    "group_clustering",
    uses="ways admins",
    more=f"""{TRIANGLES}, tagged AS (SELECT 'admins' AS grp, clustering FROM clust JOIN admins ON node = user_id
      UNION ALL SELECT 'sample', clustering FROM (SELECT * FROM clust ORDER BY {uniform('node')}, node LIMIT 5000))""",
    sql="""SELECT grp, round(avg(clustering), 9) AS mean, round(stddev_pop(clustering), 9) AS deviation,
      round(quantile_cont(clustering, 0.5), 9) AS median, count(*) AS n_samples,
      round(stddev_pop(clustering) * 1.96 / sqrt(count(*)), 9) AS error_bound FROM tagged GROUP BY 1""",
)
def group_clustering(spark, folder):
    coefficients = G.clustering_coefficients(network(spark, folder))
    admins = coefficients.join(W.admins(spark, folder), F.col("node") == F.col("user_id"))
    sample = T.hashed_sources(coefficients, 5000)
    tagged = admins.select(F.lit("admins").alias("grp"), "clustering").union(
        sample.select(F.lit("sample"), "clustering")
    )
    return rounded_columns(D.summary_with_bound(tagged, "clustering", ["grp"]), 9)


@query(
    "articulation_points",
    uses="network",
    more="""RECURSIVE ways AS MATERIALIZED (SELECT e1, e2 FROM network WHERE weight > 1
      UNION ALL SELECT e2, e1 FROM network WHERE weight > 1),
    reach AS (SELECT e1 AS cut, min(e2) AS node FROM ways GROUP BY 1
      UNION SELECT cut, e2 FROM reach JOIN ways ON node = e1 WHERE e2 <> cut)""",
    sql="""SELECT DISTINCT e1 AS node FROM ways WHERE NOT EXISTS
      (SELECT 1 FROM reach WHERE reach.cut = ways.e1 AND reach.node = ways.e2)""",
)
def articulation_points(spark, folder):
    edges = P.weight_threshold(network(spark, folder), 1, "weight")
    return T.articulation_points(edges).select("node")


def core_ctes(rounds: int) -> str:
    """Unrolled h-index rounds; once stable, further rounds change nothing."""
    steps = ["k0 AS MATERIALIZED (SELECT e1 AS node, count(*) AS core FROM ways GROUP BY 1)"]
    for i in range(rounds):
        steps.append(
            f"k{i + 1} AS MATERIALIZED (SELECT node, max(least(v, place)) AS core FROM (SELECT e1 AS node, core AS v, "
            f"row_number() OVER (PARTITION BY e1 ORDER BY core DESC) AS place FROM ways JOIN k{i} ON e2 = k{i}.node) GROUP BY 1)"
        )
    return ", ".join(steps)


@query(
    "kcore_sizes",
    uses="ways network",
    more=core_ctes(CORE_ROUNDS)
    + f""", ks AS (SELECT unnest(range(1, (SELECT max(core) + 1 FROM k{CORE_ROUNDS}))) AS k),
    ec AS (SELECT least(a.core, b.core) AS core FROM network JOIN k{CORE_ROUNDS} a ON e1 = a.node
      JOIN k{CORE_ROUNDS} b ON e2 = b.node)""",
    sql=f"""SELECT k, (SELECT count(*) FROM k{CORE_ROUNDS} WHERE core >= k) AS nodes,
      (SELECT count(*) FROM ec WHERE core >= k) AS edges FROM ks""",
)
def kcore_sizes(spark, folder):
    edges = network(spark, folder)
    return G.core_sizes(edges, G.core_numbers(edges))


EGO = f"""{TRIANGLES}, ego AS (SELECT c.node, c.degree, c.degree + c.triangles AS inside,
  CAST(sum(d.degree) AS BIGINT) - c.degree - 2 * c.triangles AS leaving
  FROM clust c JOIN ways ON c.node = e1 JOIN deg d ON e2 = d.node GROUP BY c.node, c.degree, c.triangles)"""


@query("egonet_features", uses="ways", more=EGO, sql="SELECT node, degree, inside, leaving FROM ego")
def egonet_features(spark, folder):
    return G.egonet_features(network(spark, folder))


def recursive_ctes(rounds: int) -> str:
    steps = ["rf0 AS MATERIALIZED (SELECT node, degree::DOUBLE AS f0, inside::DOUBLE AS f1, leaving::DOUBLE AS f2 FROM ego)"]
    width = 3
    for i in range(rounds):
        own = ", ".join(f"any_value(o.f{j}) AS f{j}" for j in range(width))
        means = ", ".join(f"avg(t.f{j}) AS f{width + j}" for j in range(width))
        sums = ", ".join(f"sum(t.f{j}) AS f{2 * width + j}" for j in range(width))
        steps.append(
            f"rf{i + 1} AS MATERIALIZED (SELECT o.node, {own}, {means}, {sums} FROM rf{i} o JOIN ways ON o.node = e1 "
            f"JOIN rf{i} t ON e2 = t.node GROUP BY 1)"
        )
        width *= 3
    return ", ".join(steps)


@query(
    "recursive_features",
    uses="ways",
    more=f"{EGO}, {recursive_ctes(2)}",
    sql="SELECT node, " + ", ".join(f"round(f{j}, 4) AS f{j}" for j in range(27)) + " FROM rf2",
)
def recursive_features(spark, folder):
    return rounded_columns(G.recursive_features(network(spark, folder), 2), 4)


@query(
    "adjacency_matrix",
    uses="ways",
    more="ids AS (SELECT node, rank() OVER (ORDER BY node) - 1 AS i FROM (SELECT DISTINCT e1 AS node FROM ways))",
    sql="SELECT a.i AS row, b.i AS col, 1.0::DOUBLE AS value FROM ways JOIN ids a ON e1 = a.node JOIN ids b ON e2 = b.node",
)
def adjacency_matrix(spark, folder):
    return G.adjacency_matrix(network(spark, folder))


@query(
    "user_structure_stats",
    uses="ways registered",
    more=f"""{pagerank_ctes(PAGERANK_ROUNDS, G.CUT_EVERY, PAGERANK_TOLERANCE)}, {hits_ctes(HITS_ROUNDS)}, hh AS ({HITS_SELECT}),
    us AS (SELECT user_id, count(DISTINCT article_id) AS n_articles, count(*) AS n_edits,
      ln(nullif(sum(ln(nullif(textdata, 0))), 0)) AS edit_count FROM registered GROUP BY 1)""",
    sql=f"""SELECT user_id, n_articles, n_edits, round(coalesce(edit_count, 0), 6) AS edit_count,
      round(p, 9) AS pagerank, hub FROM us JOIN settled r ON user_id = r.node JOIN hh ON user_id = hh.node""",
)
def user_structure_stats(spark, folder):
    edges = network(spark, folder)
    summary = K.user_summary(E.registered_edits(plain_edits(spark, folder))).select(
        "user_id", "n_articles", "n_edits", F.log("sum_strict_log_words").alias("edit_count")
    )
    ranks = G.pagerank(edges, PAGERANK_ROUNDS, tolerance=PAGERANK_TOLERANCE).select(F.col("node").alias("user_id"), "pagerank")
    hubs = G.hits(edges).select(F.col("node").alias("user_id"), "hub")
    rows = summary.join(ranks, "user_id").join(hubs, "user_id").na.fill(0.0)
    return rows.select(
        "user_id",
        "n_articles",
        "n_edits",
        C.rounded(F.col("edit_count")).alias("edit_count"),
        C.rounded(F.col("pagerank"), 9).alias("pagerank"),
        C.rounded(F.col("hub")).alias("hub"),
    )
