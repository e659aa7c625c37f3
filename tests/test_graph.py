import itertools
import pathlib
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from quillnet.operators import communities as K
from quillnet.operators import graph as G
from quillnet.operators import inside as I
from quillnet.operators import louvain as L
from quillnet.operators import traversal as T
from quillnet.session import cut_lineage
from tests import graphs


def as_map(frame, value):
    return {r[0]: r[value] for r in frame.collect()}


def test_sizes_and_simple_edges(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (2, 2), (2, 3)], "e1 long, e2 long")
    assert tuple(G.graph_size(G.simple_edges(pairs)).first()) == (3, 2)


def test_clustering_of_known_graphs(edge_frame):
    assert G.average_clustering(edge_frame(graphs.TRIANGLE)).first()[0] == 1.0
    assert G.average_clustering(edge_frame(graphs.STAR)).first()[0] == 0.0
    values = as_map(G.clustering_coefficients(edge_frame(graphs.BRIDGED_CLIQUES)), "clustering")
    assert values[1] == 1.0 and values[4] == pytest.approx(0.5)


def test_triangles_by_brute_force(edge_frame):
    edges = graphs.random_graph(18, 0.3, seed=5)
    table = graphs.neighbours(edges)
    expected = {v: sum(b in table[a] for a, b in itertools.combinations(table[v], 2)) for v in table}
    assert as_map(G.triangle_counts(edge_frame(edges)), "triangles") == expected


def test_pagerank_sums_to_one_and_favours_the_hub(edge_frame):
    ranks = as_map(G.pagerank(edge_frame(graphs.STAR), rounds=30, tolerance=1e-9), "pagerank")
    assert sum(ranks.values()) == pytest.approx(1.0)
    assert max(ranks, key=ranks.get) == 0


def residual(edges, hubs):
    """Of the squared adjacency matrix, relative to its largest eigenvalue, and the vector itself."""
    order = sorted(hubs)
    place = {node: i for i, node in enumerate(order)}
    matrix = np.zeros((len(order), len(order)))
    for a, b in edges:
        matrix[place[a], place[b]] = matrix[place[b], place[a]] = 1
    squared, x = matrix @ matrix, np.array([hubs[node] for node in order])
    lead = np.linalg.eigvalsh(squared)[-1]
    return np.linalg.norm(squared @ x - lead * x) / lead


TWO_BLOCKS = [
    *itertools.combinations(range(20), 2), *itertools.combinations(range(20, 40), 2), (0, 20),
]


@pytest.mark.parametrize("edges", [graphs.BRIDGED_CLIQUES, TWO_BLOCKS, graphs.TWO_TRIANGLES, graphs.random_graph(30, 0.2)])
def test_hits_settle_whatever_the_gap(edge_frame, edges):
    rows = G.hits(edge_frame(edges)).collect()
    assert sum(r.hub**2 for r in rows) == pytest.approx(1.0)
    assert all(r.hub == pytest.approx(r.authority, abs=1e-6) for r in rows)
    assert residual(edges, {r.node: r.hub for r in rows}) < 1e-10


def test_hits_with_uneven_blocks_and_a_small_gap(edge_frame):
    """The second block is one link short, so power rounds would need thousands."""
    edges = [pair for pair in TWO_BLOCKS if pair != (38, 39)]
    hubs = as_map(G.hits(edge_frame(edges)), "hub")
    assert residual(edges, hubs) < 1e-10
    matrix = np.zeros((40, 40))
    for a, b in edges:
        matrix[a, b] = matrix[b, a] = 1
    exact = np.abs(np.linalg.eigh(matrix)[1][:, -1])
    assert [hubs[i] for i in range(40)] == pytest.approx(list(exact), abs=1e-7)


def test_hits_of_a_star_split_hubs_from_leaves(edge_frame):
    """A bipartite network has two leading eigenvalues; a start of ones gives both sides their share."""
    rows = {r.node: (r.hub, r.authority) for r in G.hits(edge_frame(graphs.STAR)).collect()}
    ones = np.ones(7)
    matrix = np.zeros((7, 7))
    matrix[0, 1:] = matrix[1:, 0] = 1
    for _ in range(40):
        authority = matrix @ ones
        ones = matrix @ authority
        ones, authority = ones / np.linalg.norm(ones), authority / np.linalg.norm(authority)
    assert [rows[i][0] for i in range(7)] == pytest.approx(list(ones))
    assert [rows[i][1] for i in range(7)] == pytest.approx(list(authority))


def test_hits_without_links_and_out_of_sweeps(spark, edge_frame):
    assert G.hits(spark.createDataFrame([], "e1 long, e2 long, weight long")).collect() == []
    with pytest.warns(UserWarning, match="hits did not reach"):
        G.hits(edge_frame(graphs.PATH), tolerance=0.0, sweeps=1, width=2)


@pytest.mark.parametrize("nodes, density", [(150, 0.03), (60, 0.05)])
def test_neighbourhood_sketches_stay_within_their_error(edge_frame, nodes, density):
    edges = graphs.random_graph(nodes, density, seed=4)
    table = graphs.neighbours(edges)
    exact = [d for node in table for d in graphs.distances(table, node).values()]
    found = as_map(T.neighbourhood_function(edge_frame(edges), lg_k=10), "pairs")
    assert set(range(max(exact) + 1)) <= set(found)
    for level in found:
        true = sum(d <= level for d in exact)
        assert abs(found[level] - true) <= 3 * 1.04 / 2**5 * true
    row = T.sketched_diameter(edge_frame(edges), lg_k=12).first()
    assert row.average_path == pytest.approx(sum(exact) / len(exact), rel=0.05)


def test_sketches_are_merged_in_tiles_and_kept_small(edge_frame, monkeypatch):
    """the sketches of a range of nodes are one compressed row; the ranges and a hub change no result."""
    edges = graphs.random_graph(150, 0.05, seed=4) + [(1000, i) for i in range(1001, 1101)]
    kept, written = T.next_state, []

    def next_state(df, *replaced):
        state = kept(df, *replaced)
        written.append(sum(f.stat().st_size for f in pathlib.Path(state.written_to.removeprefix("file:")).glob("*.parquet")))
        return state

    monkeypatch.setattr(T, "next_state", next_state)
    whole = as_map(T.neighbourhood_function(edge_frame(edges)), "pairs")
    assert max(written) < 600 * len(graphs.neighbours(edges))
    monkeypatch.setattr(T, "SKETCH_BITS", 14)  # 16 nodes a range
    found = as_map(T.neighbourhood_function(edge_frame(edges)), "pairs")
    assert found == pytest.approx(whole, abs=2)


def plan_size(frame):
    """Operators of the plan, one a line; its characters vary with the digits of column numbers."""
    return len(frame._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_plans_of_searches_do_not_grow_with_the_diameter(edge_frame):
    short, long = ([(i, i + 1) for i in range(n)] for n in (3, 7))
    for measure in (lambda e: T.neighbourhood_function(e, 8), lambda e: T.betweenness(e)[1], T.effective_diameter):
        assert plan_size(measure(edge_frame(short))) == plan_size(measure(edge_frame(long)))


def test_core_numbers_by_peeling(edge_frame):
    edges = graphs.random_graph(25, 0.2, seed=9)
    cores = G.core_numbers(edge_frame(edges))
    assert as_map(cores, "core") == graphs.core_numbers(edges)
    sizes = sorted(tuple(r) for r in G.core_sizes(edge_frame(edges), cores).collect())
    assert sizes[0][1:] == (len(graphs.neighbours(edges)), len(edges))
    assert all(a[1] >= b[1] and a[2] >= b[2] for a, b in zip(sizes, sizes[1:]))


def test_egonet_features(edge_frame):
    rows = {r.node: (r.degree, r.inside, r.leaving) for r in G.egonet_features(edge_frame(graphs.BRIDGED_CLIQUES)).collect()}
    assert rows[1] == (3, 6, 1)
    assert rows[4] == (4, 7, 3)


def test_recursive_features_append_means_and_sums(edge_frame):
    rows = {r.node: r for r in G.recursive_features(edge_frame(graphs.STAR), 1).collect()}
    assert len(rows[0]) == 1 + 9
    assert (rows[0].f0, rows[0].f3, rows[0].f6) == (6.0, 1.0, 6.0)


def test_adjacency_is_symmetric(edge_frame):
    cells = {(r.row, r.col) for r in G.adjacency_matrix(edge_frame(graphs.PATH)).collect()}
    assert cells == {(b, a) for a, b in cells} and len(cells) == 8


@pytest.mark.parametrize("edges", [graphs.BRIDGED_CLIQUES, graphs.TWO_TRIANGLES, graphs.PATH, graphs.random_graph()])
def test_articulation_points(edge_frame, edges):
    assert {r.node for r in T.articulation_points(edge_frame(edges)).collect()} == graphs.cut_vertices(edges)


def test_eccentricity_in_batches(edge_frame):
    edges = graphs.random_graph()
    table = graphs.neighbours(edges)
    expected = {v: max(graphs.distances(table, v).values()) for v in table}
    assert as_map(T.eccentricities(edge_frame(edges), batch=8), "eccentricity") == expected


def test_betweenness_by_brute_force(edge_frame):
    edges = graphs.random_graph()
    nodes, links = T.betweenness(edge_frame(edges), batch=9)
    expected = graphs.betweenness(edges)
    assert as_map(nodes, "betweenness") == pytest.approx(expected)
    bridge = {(r.e1, r.e2): r.betweenness for r in T.betweenness(edge_frame(graphs.BRIDGED_CLIQUES))[1].collect()}
    assert bridge[(4, 11)] == pytest.approx(16.0)


def test_betweenness_in_tiles(edge_frame, monkeypatch):
    """a state is a row per range of nodes and block of sources, not one per source and node; ranges and batches change no result."""
    edges = [*graphs.random_graph(40, 0.15), (100, 101), *[(100, leaf) for leaf in range(200, 270)]]
    kept, rows = T.cut_lineage, []

    def cut_lineage(df):
        state = kept(df)
        rows.append((state.columns, state.count()))
        return state

    monkeypatch.setattr(T, "cut_lineage", cut_lineage)
    monkeypatch.setattr(T, "MOST_BITS", 5)  # 32 nodes a range
    nodes, links = T.betweenness(edge_frame(edges), batch=64)
    expected = graphs.betweenness(edges)
    assert as_map(nodes, "betweenness") == pytest.approx(expected)
    flows = {(r.e1, r.e2): r.betweenness for r in links.collect()}
    assert flows.keys() == set(edges) and flows[(100, 101)] == pytest.approx(71.0)
    assert max(n for columns, n in rows if columns != ["node", "idx"]) <= 16


def test_effective_diameter_of_a_path(edge_frame):
    row = T.effective_diameter(edge_frame(graphs.PATH), sources=5).first()
    assert row.diameter == 4
    assert row.average_path == pytest.approx(40 / 25)
    # Pairs by distance are 5, 8, 6, 4, 2; 90 % of 25 lies between distances 2 and 3.
    assert row.effective_diameter == pytest.approx(2 + (22.5 - 19) / 4)


def test_components(edge_frame):
    found = as_map(T.connected_components(edge_frame(graphs.TWO_TRIANGLES)), "component")
    assert found == {1: 1, 2: 1, 3: 1, 11: 11, 12: 11, 13: 11}


@pytest.mark.parametrize("score", [L.NEWMAN, L.INDETERMINISM])
def test_louvain_finds_bridged_cliques(edge_frame, score):
    edges = edge_frame(graphs.BRIDGED_CLIQUES)
    levels = L.louvain(edges, score).cache()
    scores = [
        K.modularity(edges, L.hierarchy_level(levels, r.level)).first()[score]
        for r in levels.select("level").distinct().orderBy("level").collect()
    ]
    assert scores == sorted(scores)
    last = L.hierarchy_level(levels, len(scores) - 1).collect()
    groups = {}
    for r in last:
        groups.setdefault(r.community_id, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4], [11, 12, 13, 14]]


def test_modularity_of_two_triangles(spark, edge_frame):
    assignment = spark.createDataFrame([(n, n > 9) for n in (1, 2, 3, 11, 12, 13)], "node long, c boolean")
    assignment = assignment.selectExpr("node", "int(c) as community_id")
    row = K.modularity(edge_frame(graphs.TWO_TRIANGLES), assignment).first()
    assert row.modularity == pytest.approx(0.5)
    assert row.indeterminism == pytest.approx(0.5)


def test_cores_of_a_long_chain(edge_frame):
    """A chain sheds one node from each end a round: the search has to go on until nothing moves."""
    edges = edge_frame([(k, k + 1) for k in range(60)])
    assert {r.core for r in G.core_numbers(edges).collect()} == {1}


def test_replaced_states_are_dropped(spark, edge_frame):
    import os

    from quillnet.session import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    edges = edge_frame(graphs.random_graph())
    before = len(os.listdir(folder))
    assert G.pagerank(edges).count()
    assert len(os.listdir(folder)) - before <= 1


def test_louvain_level_ends_where_no_node_wants_to_move(edge_frame):
    """Next to a heavy edge, later moves in a light network raise the score by far less than a thousandth."""
    weights = dict.fromkeys(graphs.random_graph(40, 0.15), 1) | {(101, 102): 10_000}
    edges = edge_frame([(1, 2)]).sparkSession.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "e1 long, e2 long, weight long")
    found = as_map(L.hierarchy_level(L.louvain(edges, max_levels=1), 0), "community_id")
    m2 = 2 * sum(weights.values())
    degree = dict.fromkeys(found, 0)
    for (a, b), w in weights.items():
        degree[a] += w
        degree[b] += w

    def score(groups):
        inner = sum(2 * w for (a, b), w in weights.items() if groups[a] == groups[b])
        totals = {}
        for node, c in groups.items():
            totals[c] = totals.get(c, 0) + degree[node]
        return inner / m2 - sum(t * t for t in totals.values()) / m2**2

    reached = score(found)
    for a, b in weights:
        assert score(found | {a: found[b]}) <= reached + 1e-12
        assert score(found | {b: found[a]}) <= reached + 1e-12


def test_pagerank_reports_a_missed_tolerance(edge_frame):
    with pytest.warns(UserWarning, match="tolerance"):
        G.pagerank(edge_frame(graphs.STAR), rounds=2, tolerance=1e-12)


def test_moves_made_together_raise_the_score(spark, edge_frame):
    """Every round of many moves raises both scores, from the first to the last."""
    edges = edge_frame(graphs.random_graph(60, 0.12))
    for score in (L.NEWMAN, L.INDETERMINISM):
        links = L.both_ways(edges, "weight").selectExpr("e1", "e2", "CAST(weight AS DOUBLE) AS w")
        state = links.groupBy("e1").agg(F.sum("w").alias("k")).selectExpr("e1 AS node", "e1 AS c", "k", "1D AS s", L.FIRST)
        state = cut_lineage(state)
        links = cut_lineage(L._with_weights(links, state))
        m2, n = state.agg(F.sum("k"), F.sum("s")).first()
        value = lambda s: K.modularity(edges, s.select("node", F.col("c").alias("community_id"))).first()[score]
        before = value(state)
        for _ in range(4):
            wanted = cut_lineage(L.wanted_moves(links, state, m2, n, score))
            if wanted.filter("rise > 0").isEmpty():
                break
            moved = cut_lineage(L.settled(wanted, m2, n, score))
            assert moved.join(state.withColumnRenamed("c", "old"), "node").filter("c <> old").count()
            state, now = moved, value(moved)
            assert now > before
            before = now


def test_a_stored_hierarchy_reads_one_level(spark, tmp_path):
    path = str(tmp_path / "levels")
    for level in range(3):
        L.append_level(spark.createDataFrame([(n, n // 2**level) for n in range(8)], "node long, community_id long"), level, path)
    found = L.hierarchy_level(L.read_hierarchy(spark, path), 2)
    assert as_map(found, "community_id") == {n: n // 4 for n in range(8)}
    assert "PartitionFilters: [isnotnull(level" in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("words", [None, 2])
def test_searches_keep_many_lanes_in_a_row(edge_frame, monkeypatch, words):
    """150 sources are three lanes, but a level has no more rows than nodes (and blocks of lanes)."""
    draw, rows = random.Random(8), []
    edges = sorted({tuple(sorted(draw.sample(range(150), 2))) for _ in range(260)})
    nodes = sorted({v for e in edges for v in e})
    kept = T.next_state
    monkeypatch.setattr(T, "next_state", lambda df, *old: (state := kept(df, *old), rows.append(state.count()))[0])
    links = T.written_links(edge_frame(edges))
    sources = links.sparkSession.createDataFrame(list(zip(nodes, range(len(nodes)))), "node long, idx long")
    levels = T.bfs_levels(links, sources, *([] if words is None else [words])).collect()
    assert max(rows) <= len(nodes) * (1 if words is None else 2)
    near = {v: {b if a == v else a for a, b in edges if v in (a, b)} for v in nodes}
    expected = {}
    for idx, source in enumerate(nodes):
        seen, front, level = set(), {source}, 0
        while front:
            reached, fresh = expected.get((level, idx // 64), (0, 0))
            expected[level, idx // 64] = reached + len(front), fresh | 1 << idx % 64
            seen |= front
            front, level = {n for v in front for n in near[v]} - seen, level + 1
    assert {(r.level, r.lane): (r.reached, r.fresh % 2**64) for r in levels} == expected


def test_core_estimates_are_not_broadcast(edge_frame, monkeypatch):
    plans, kept = [], G.next_state
    monkeypatch.setattr(G, "next_state", lambda df, *old: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, *old))[1])
    edges = edge_frame(graphs.random_graph())
    sizes = G.core_sizes(edges, G.core_numbers(edges))
    assert len(plans) > 0 and not any("BroadcastHashJoin" in plan for plan in plans)
    joins = [line for line in sizes._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [e" in line]
    assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins)


def test_louvain_takes_few_rounds_and_keeps_only_rises(edge_frame, monkeypatch):
    """Rounds are judged by the sum of what nodes hold, which is the score but for a constant, and bold ones end a level in few passes."""
    passes, kept = [], []
    wanted, standing = L.wanted_moves, L._standing
    monkeypatch.setattr(L, "wanted_moves", lambda *a: passes.append(1) or wanted(*a))
    monkeypatch.setattr(L, "_standing", lambda table: kept.append(standing(table)) or kept[-1])
    edges = edge_frame(graphs.random_graph(250, 0.15))
    found = L.hierarchy_level(L.louvain(edges, max_levels=1), 0)
    assert len(passes) < 60
    # The sum of what nodes hold is the modularity but for a constant: from the first state to the last.
    m2 = 2 * edges.count()
    start = edges.selectExpr("inline(array(named_struct('node', e1), named_struct('node', e2)))").distinct().selectExpr("node", "node AS community_id")
    rise = K.modularity(edges, found).first().modularity - K.modularity(edges, start).first().modularity
    assert max(k[0] for k in kept) - kept[0][0] == pytest.approx(rise * m2, abs=1e-6)


def spread_out(edges):
    """Three components, one with a hub and a long tail."""
    return [*edges, (100, 101), *[(100, leaf) for leaf in range(200, 290)], *[(300 + k, 301 + k) for k in range(10)]]


@pytest.mark.parametrize("limit", [1 << 24, 8])
def test_searches_inside_tasks_and_between_them_agree(edge_frame, monkeypatch, limit):
    """Whole components go to tasks and no state is written where they fit; both ways give brute force."""
    levels = []
    for name in ("write_level", "bfs_levels"):
        kept = getattr(T, name)
        monkeypatch.setattr(T, name, lambda *a, kept=kept, name=name: levels.append(name) or kept(*a))
    monkeypatch.setattr(I, "MOST_LINKS", limit)
    monkeypatch.setattr(I, "BUNDLE_BITS", 5)
    monkeypatch.setattr(I, "STATE_BYTES", 1 << 16)  # few sources at once
    edges = spread_out(graphs.random_graph(40, 0.15))
    table = graphs.neighbours(edges)
    far = {v: max(graphs.distances(table, v).values()) for v in table}
    assert as_map(T.eccentricities(edge_frame(edges)), "eccentricity") == far
    assert levels.count("bfs_levels") == (limit == 8)
    levels.clear()
    nodes, links = T.betweenness(edge_frame(edges))
    assert as_map(nodes, "betweenness") == pytest.approx(graphs.betweenness(edges))
    assert len(levels) == 1 if limit > 8 else len(levels) > 10
    flows = {(r.e1, r.e2): r.betweenness for r in links.collect()}
    assert flows.keys() == set(edges) and flows[(100, 101)] == pytest.approx(91.0) and flows[(300, 301)] == pytest.approx(10.0)


def test_sampled_sources_inside_tasks_scale_up(edge_frame, monkeypatch):
    edges = edge_frame(graphs.random_graph(60, 0.1))
    inside = as_map(T.node_betweenness(edges, source_fraction=0.5), "betweenness")
    monkeypatch.setattr(I, "MOST_LINKS", 8)
    assert as_map(T.node_betweenness(edges, source_fraction=0.5), "betweenness") == pytest.approx(inside)
    assert sum(inside.values()) > 0


def test_more_sources_than_a_row_holds(spark):
    """A cycle of 150 nodes: eccentricities by words of 64 sources, and flows that are equal everywhere."""
    a = np.repeat(np.arange(150, dtype=np.int32), 2)
    b = np.array([sorted(((v - 1) % 150, (v + 1) % 150)) for v in range(150)], np.int32).ravel()
    every = np.arange(150, dtype=np.int32)
    links = I.Links([a], [b], every)
    assert set(I.eccentricity_of(links, every)) == {75}
    total, flows = I.dependencies_of(links, every, True)
    assert np.ptp(total) < 1e-9 and np.ptp(I.both_flows(links, flows)[2]) < 1e-9
    assert total[0] == pytest.approx(150 * (sum(range(75)) * 2 + 75) / 150 - 149)


@pytest.mark.parametrize("score", [L.NEWMAN, L.INDETERMINISM])
def test_louvain_rounds_inside_tasks_are_those_between_them(spark, monkeypatch, score):
    """Two components of weighted links: the same communities in a few passes over the network instead of one per round."""
    draw = random.Random(11)
    pairs = graphs.random_graph(90, 0.12) + [(a + 500, b + 500) for a, b in graphs.random_graph(40, 0.2)]
    edges = spark.createDataFrame([(a, b, draw.randrange(1, 4)) for a, b in pairs], "e1 long, e2 long, weight long").cache()
    passes, found, wanted = [], {}, L.wanted_moves
    monkeypatch.setattr(L, "wanted_moves", lambda *a: passes.append(1) or wanted(*a))
    for limit in (1 << 24, 8):
        monkeypatch.setattr(I, "MOST_LINKS", limit)
        passes.clear()
        levels = {(r.level, r.node): r.community_id for r in L.louvain(edges, score).collect()}
        found[limit] = levels, len(passes)
    assert found[8][0] == found[1 << 24][0]
    assert found[1 << 24][1] <= 9 < found[8][1]


@pytest.mark.parametrize("score", [L.NEWMAN, L.INDETERMINISM])
@pytest.mark.parametrize("caution", L.CAUTIONS)
def test_one_round_in_arrays(spark, score, caution):
    draw = random.Random(5)
    pairs = {(a, b): draw.randrange(1, 5) for a, b in graphs.random_graph(70, 0.15)}
    nodes = sorted({v for pair in pairs for v in pair})
    ways = sorted([(a, b, float(w)) for (a, b), w in pairs.items()] + [(b, a, float(w)) for (a, b), w in pairs.items()])
    k = {v: sum(w for a, _, w in ways if a == v) for v in nodes}
    c = {v: nodes[draw.randrange(len(nodes))] for v in nodes}
    m2, n = sum(k.values()), float(len(nodes))
    links = spark.createDataFrame([(a, b, w, k[a], 1.0) for a, b, w in ways], "e1 long, e2 long, w double, k double, s double")
    state = spark.createDataFrame([(v, c[v], k[v], 1.0, 3) for v in nodes], "node long, c long, k double, s double, turn long")
    table = L.wanted_moves(links, state, m2, n, score)
    expected = {r.node: (r.held, r.rise, r.target if r.rise else None) for r in table.collect()}
    moved = {r.node: r.c for r in L.settled(table, m2, n, score, caution).collect()}
    at = {v: p for p, v in enumerate(nodes)}
    a, b, w = (np.array(x) for x in zip(*[(at[a], at[b], w) for a, b, w in ways]))
    rounds = L.Rounds(a, b, w, np.array(nodes), np.array([k[v] for v in nodes]), np.ones(len(nodes)), m2, n, score)
    here = np.array([at[c[v]] for v in nodes])
    target, held, rise = found = rounds.wanted(here)
    assert sum(x > 0 for x in rise) > 10
    for v, p in at.items():
        assert (held[p], rise[p]) == pytest.approx(expected[v][:2], abs=1e-8)
        assert expected[v][2] in (None, nodes[target[p]])
    after = rounds.settled(here, 3, found, caution)
    assert {v: nodes[after[p]] for v, p in at.items()} == moved
    assert moved != c


def test_cores_and_sketches_inside_tasks_and_between_them_agree(edge_frame, monkeypatch):
    """Peeling and hops of whole components in tasks, with few tables written, against rounds over all links."""
    written, kept = [], I.cut_lineage.__globals__["scratch_path"]
    monkeypatch.setitem(I.cut_lineage.__globals__, "scratch_path", lambda *a: written.append(a[1]) or kept(*a))
    edges = spread_out(graphs.random_graph(80, 0.1))
    found, tables = {}, {}
    monkeypatch.setattr(I, "BUNDLE_BITS", 4)
    for limit in (1 << 24, 8):
        monkeypatch.setattr(I, "MOST_LINKS", limit)
        written.clear()
        pairs = as_map(T.neighbourhood_function(edge_frame(edges), 8), "pairs")
        tables[limit] = len(written)
        found[limit] = pairs, as_map(G.core_numbers(edge_frame(edges)), "core")
    assert found[8][1] == found[1 << 24][1] == graphs.core_numbers(edges)
    assert found[8][0] == pytest.approx(found[1 << 24][0], abs=2) and len(found[8][0]) == 11
    assert tables[1 << 24] < tables[8]
