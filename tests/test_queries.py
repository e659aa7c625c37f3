import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from oracle_check import canonical_rows

QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()

CHECKED = [
    "human_edits", "edit_ranks", "unpack_node_id", "next_period_contribution", "user_projection",
    "sampled_user_projection", "fixed_count_clique_sample", "jaccard_similarity_exact", "threshold_sweep",
    "retention_by_words_quartile", "clique_percentiles", "kernel_density", "user_feature_vectors",
    "user_article_features", "peer_norm_features", "article_community_features", "community_interactions", "modularity",
    "clustering_coefficient", "pagerank", "betweenness", "kcore_sizes", "articulation_points", "leave_self_out_role_mean",
    "feature_union_join", "classification_metrics", "parse_revision", "nearest_day_blocks",
]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship_entry(spark):
    rows = entry_point.entry(spark)
    assert rows.columns == ["e1", "e2", "weight"] and rows.count() > 0


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("key", CHECKED)
def test_query_matches_its_oracle(spark, folder, duck, key):
    frame = QUERIES[key](spark, folder)
    cursor = duck.execute(ORACLES[key])
    names = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    assert canonical_rows(frame.columns, [tuple(r) for r in frame.collect()]) == canonical_rows(names, cursor.fetchall())
