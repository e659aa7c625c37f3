"""Readers and writers, exercised by writing the edit log to the shared folder and reading it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillnet.operators import bipartite as B
from quillnet.operators import features as X
from quillnet.operators import projection as P
from quillnet.plans.distribution_plans import human
from quillnet.plans.edits_plans import EDIT_COLUMNS
from quillnet.plans.feature_plans import OWN, rounded_columns
from quillnet.plans.projection_plans import plain_edits
from quillnet.plans.registry import query
from quillnet.session import scratch_path
from quillnet.sources import edit_log as L
from quillnet.sources import tables as T
from quillnet.sources import warehouse as W


def records(spark, folder, compression=None):
    path = scratch_path(spark, "records")
    L.write_edit_records(W.edits(spark, folder, category=True), path, compression)
    return L.read_edit_records(spark, path)


STAMP = """strftime("timestamp", '%Y-%m-%dT%H:%M:%SZ')"""


@query(
    "read_edit_records",
    uses="edits",
    sql=f"""SELECT concat_ws(' ', article_id, rev_id, concat('Article_', article_id), {STAMP}, username, user_id) AS revision,
      category, CAST(NULL AS VARCHAR) AS comment, CAST(minor::INT AS VARCHAR) AS minor, CAST(textdata AS VARCHAR) AS textdata
    FROM edits""",
)
def read_edit_records(spark, folder):
    return records(spark, folder, "bzip2").select("revision", "category", "comment", "minor", "textdata")


@query(
    "parse_revision",
    uses="edits",
    sql="""SELECT CAST(article_id AS INT) AS article_id, CAST(rev_id AS INT) AS rev_id, concat('Article_', article_id) AS article_title,
      "timestamp", username, user_id, category, minor, textdata, year, quarter FROM edits""",
)
def parse_revision(spark, folder):
    return L.parse_revision(records(spark, folder)).drop(*L.WIDE_TEXT)


@query(
    "simple_edit_rows",
    uses="edits",
    sql=f"""SELECT CAST(article_id AS VARCHAR) AS article_id, user_id, CAST(minor::INT AS VARCHAR) AS minor,
      CAST(textdata AS VARCHAR) AS word_count, CAST(lower(username) LIKE '%bot%' AS INT) AS has_bot, {STAMP} AS "timestamp"
    FROM edits WHERE user_id NOT LIKE 'ip:%'""",
)
def simple_edit_rows(spark, folder):
    return L.simple_edit_rows(records(spark, folder))


def tsv(spark, folder):
    path = scratch_path(spark, "tsv")
    rows = plain_edits(spark, folder).select(
        "article_id", "user_id", F.col("minor").cast("int"), "textdata", "timestamp"
    )
    rows.write.csv(path, sep="\t")
    return L.read_edit_tsv(spark, path)


@query(
    "read_edit_tsv",
    uses="edits",
    sql="""SELECT CAST(article_id AS INT) AS article_id, user_id, minor::INT AS minor, textdata AS word_count, "timestamp"
    FROM edits""",
)
def read_edit_tsv(spark, folder):
    return tsv(spark, folder)


@query(
    "clean_edits",
    uses="edits",
    sql="""SELECT CAST(article_id AS INT) AS article_id, TRY_CAST(user_id AS BIGINT) AS user_id, minor::INT AS minor,
      textdata AS word_count, "timestamp", year, quarter FROM edits ORDER BY "timestamp" """,
)
def clean_edits(spark, folder):
    return L.clean_edits(tsv(spark, folder))


EDIT_SQL = 'SELECT rev_id, article_id, user_id, username, "timestamp", minor, textdata, year, quarter FROM edits'


@query("write_partitioned", uses="edits", sql=EDIT_SQL)
def write_partitioned(spark, folder):
    path = scratch_path(spark, "partitioned")
    L.write_partitioned(W.edits(spark, folder), path)
    return spark.read.parquet(path).select(*EDIT_COLUMNS)


@query("compact_edits", uses="edits", sql=EDIT_SQL)
def compact_edits(spark, folder):
    path = scratch_path(spark, "compact")
    wide = W.edits(spark, folder).withColumn("comment", F.concat(F.lit("about "), "article_id"))
    L.compact_edits(wide, path)
    return spark.read.parquet(path).select(*EDIT_COLUMNS)


@query(
    "column_sizes",
    uses="edits",
    more="""sizes AS (SELECT 'user_id' AS name, length(user_id) AS n FROM edits UNION ALL SELECT 'username', length(username) FROM edits
      UNION ALL SELECT 'category', length(category) FROM edits)""",
    sql="""SELECT name, round(sum(n) / 1e6, 6) AS megabytes, round(avg(n), 6) AS mean_length, round(stddev_samp(n), 6) AS sd_length,
      CAST(min(n) AS INT) AS min_length, CAST(max(n) AS INT) AS max_length FROM sizes GROUP BY 1""",
)
def column_sizes(spark, folder):
    return rounded_columns(L.column_sizes(W.edits(spark, folder, category=True), ["user_id", "username", "category"]))


@query("read_view", uses="edits", sql="SELECT year, quarter, count(*) AS n FROM edits GROUP BY 1, 2")
def read_view(spark, folder):
    path = scratch_path(spark, "view")
    plain_edits(spark, folder).write.parquet(path)
    T.read_view(spark, path, "edit_log")
    return spark.sql("SELECT year, quarter, count(*) AS n FROM edit_log GROUP BY year, quarter")


@query("write_edge_list", uses="network", sql="SELECT e1, e2, weight FROM network")
def write_edge_list(spark, folder):
    path = scratch_path(spark, "edges")
    T.write_edge_list(P.user_network(B.memberships(plain_edits(spark, folder))), path)
    return T.read_edge_list(spark, path, "e1 LONG, e2 LONG, weight LONG")


@query("read_assignments", uses="roles", sql="SELECT user_id, role_id FROM roles")
def read_assignments(spark, folder):
    path = scratch_path(spark, "roles")
    lines = W.role_labels(spark, folder).select(F.concat_ws("\t", F.concat(F.lit(" "), "user_id"), "role_id").alias("value"))
    # The comment line stands for what the program that wrote such files put between its rows.
    spark.range(1).select(F.lit("--- roles").alias("value")).union(lines).write.text(path)
    return T.read_assignments(spark, path, "user_id LONG, role_id INT")


@query(
    "read_admin_names",
    sql="SELECT c_name AS username FROM customer",
)
def read_admin_names(spark, folder):
    path = scratch_path(spark, "names")
    people = W.table(spark, folder, "customer")
    people.select(F.concat(F.lit("* User: "), "c_name", F.lit(" ")).alias("value")).write.text(path)
    return T.read_admin_names(spark, path)


@query(
    "write_feature_csv",
    uses="human",
    more=OWN,
    sql="SELECT user_id, num_edits, sum_textdata, sumlog_textdata, p_distinct FROM own",
)
def write_feature_csv(spark, folder):
    path = scratch_path(spark, "features")
    rows = rounded_columns(X.user_features(human(spark, folder)))
    T.write_feature_csv(rows.select("user_id", "num_edits", "sum_textdata", "sumlog_textdata", "p_distinct"), path)
    schema = "user_id STRING, num_edits LONG, sum_textdata LONG, sumlog_textdata DOUBLE, p_distinct DOUBLE"
    return spark.read.csv(path, schema=schema)


@query(
    "vector_text",
    uses="vectors",
    sql="""SELECT concat_ws(chr(9), user_id, array_to_string(list_transform(vec, lambda x: CAST(CAST(floor(x * 1000) AS BIGINT) AS VARCHAR)), chr(9)))
      AS value FROM vectors""",
)
def vector_text(spark, folder):
    rows = W.role_vectors(spark, folder).withColumn("vec", F.transform("vec", lambda x: F.floor(x * 1000)))
    return T.vector_lines(rows, "user_id", ["vec"])
