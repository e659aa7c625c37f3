"""Small graphs and brute-force measures to compare with."""

import collections
import itertools
import random

TRIANGLE = [(1, 2), (2, 3), (1, 3)]
PATH = [(1, 2), (2, 3), (3, 4), (4, 5)]
STAR = [(0, leaf) for leaf in range(1, 7)]
TWO_TRIANGLES = [*TRIANGLE, (11, 12), (12, 13), (11, 13)]
BRIDGED_CLIQUES = [
    *itertools.combinations(range(1, 5), 2),
    *itertools.combinations(range(11, 15), 2),
    (4, 11),
]


def random_graph(nodes=22, density=0.11, seed=3):
    draw = random.Random(seed)
    return [pair for pair in itertools.combinations(range(nodes), 2) if draw.random() < density]


def neighbours(edges):
    table = collections.defaultdict(set)
    for a, b in edges:
        table[a].add(b)
        table[b].add(a)
    return table


def distances(table, source, banned=None):
    found, queue = {source: 0}, [source]
    for node in queue:
        for other in table[node]:
            if other != banned and other not in found:
                found[other] = found[node] + 1
                queue.append(other)
    return found


def component_count(table, banned=None):
    left, count = set(table) - {banned}, 0
    while left:
        left -= set(distances(table, next(iter(left)), banned))
        count += 1
    return count


def cut_vertices(edges):
    table = neighbours(edges)
    base = component_count(table)
    return {node for node in table if component_count(table, node) > base}


def betweenness(edges):
    table = neighbours(edges)
    paths = {}
    for source in table:
        dist = distances(table, source)
        sigma = collections.Counter({source: 1})
        for node in sorted(dist, key=dist.get):
            for other in table[node]:
                if dist[other] == dist[node] + 1:
                    sigma[other] += sigma[node]
        paths[source] = dist, sigma
    result = dict.fromkeys(table, 0.0)
    for s, t in itertools.combinations(sorted(table), 2):
        if t not in paths[s][0]:
            continue
        for v in table:
            if v not in (s, t) and v in paths[s][0] and paths[s][0][v] + paths[t][0][v] == paths[s][0][t]:
                result[v] += paths[s][1][v] * paths[t][1][v] / paths[s][1][t]
    return result


def core_numbers(edges):
    left = {node: set(others) for node, others in neighbours(edges).items()}
    cores, level = {}, 0
    while left:
        node = min(left, key=lambda v: len(left[v]))
        level = max(level, len(left[node]))
        cores[node] = level
        for other in left.pop(node):
            left[other].discard(node)
    return cores
