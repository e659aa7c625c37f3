"""From raw documents to token ids: STAGES in order, each written and read again as the next one's documents.

A stage gets (spark, docs, sf_dir) and works on every document its predecessor kept. All but the last return the
columns of documents. Null texts count as empty, which no quality rule lets pass. A document is a row of one id and one text: repeated rows are
one document after the second stage, further texts of an id are documents of their own, and so are those without an id,
which stand for a group only if it has no id at all. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillnet.llm import ngram_join, quality, secret_scan, sentence_pieces, source_mix
from quillnet.llm.common import State, prepare, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def sized(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    prepare(spark)
    return quality.cascade(docs).filter(F.col("rejected_by").isNull()).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shared shingles, the one with the smallest id; of equal ids, that of the smallest hash."""
    prepare(spark)
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    found = ngram_join.jaccard_components(keyed, key="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    rows = keyed.select("_row", order.alias("_order")).distinct()
    first = found.distinct().join(rows, "_row").groupBy("_group").agg(F.min("_order").alias("_order")).select("_order._row").distinct()
    kept = keyed.join(first, "_row", "left_semi")
    # The checksum keeps apart what the hash alone might not.
    return kept.withColumn("_sum", F.crc32(F.col("text").cast("binary"))).dropDuplicates(["doc_id", "_row", "_sum"]).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by its kind."""
    prepare(spark)
    found = secret_scan.scan(docs)
    return sized(found.withColumn("text", secret_scan.redact(F.col("text"), F.col("spans"))))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a document for each whole pass, and one of its drawn blocks."""
    prepare(spark)
    return sized(source_mix.mixed_documents(docs))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to its text."""
    prepare(spark)
    coded = sentence_pieces.encode(docs)
    back = sentence_pieces.decoded()(F.col("ids"))
    return coded.select("doc_id", "source", "lang", "ids", F.size("ids").alias("n_tokens"), (back == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", source_weights),
    ("SentencePiece encoding and decoding", piece_ids),
]

# Piece ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    state = None
    for _, stage in STAGES:
        newer = State(stage(spark, docs, sf_dir), "stage")
        if state:
            state.drop()
        docs, state = newer.df, newer
    return docs
