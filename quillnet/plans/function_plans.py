"""The scalar functions the jobs rely on, over the whole edit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillnet.functions import columns as C
from quillnet.plans.projection_plans import plain_edits
from quillnet.plans.registry import query
from quillnet.sources import warehouse as W


@query(
    "math_functions",
    uses="edits",
    sql="""SELECT rev_id, article_id, round(ln(nullif(textdata, 0)), 6) AS ln_words, round(exp(textdata / 1250), 6) AS exp_words,
      round(sqrt(textdata), 6) AS sqrt_words, year % 10 AS year_digit, greatest(textdata, 20) AS at_least,
      CAST(ceil(textdata / 7) AS BIGINT) AS weeks FROM edits""",
)
def math_functions(spark, folder):
    words = F.col("textdata")
    return plain_edits(spark, folder).select(
        "rev_id",
        "article_id",
        F.round(F.log(words), 6).alias("ln_words"),
        F.round(F.exp(words / 1250), 6).alias("exp_words"),
        F.round(F.sqrt(words), 6).alias("sqrt_words"),
        (F.col("year") % 10).alias("year_digit"),
        F.greatest(words, F.lit(20)).alias("at_least"),
        F.ceil(words / 7).alias("weeks"),
    )


@query(
    "string_functions",
    uses="edits",
    sql="""SELECT rev_id, article_id, string_split(category, ' ')[1] AS head, lower(username) AS name, left(username, 4) AS first,
      right(username, 4) AS last, CAST(length(category) AS INT) AS size, regexp_matches(username, '(?i)bot') AS bot,
      concat(user_id, '@', article_id) AS tag FROM edits""",
)
def string_functions(spark, folder):
    return W.edits(spark, folder, category=True).select(
        "rev_id",
        "article_id",
        F.split("category", " ")[0].alias("head"),
        F.lower("username").alias("name"),
        F.left("username", F.lit(4)).alias("first"),
        F.right("username", F.lit(4)).alias("last"),
        F.length("category").alias("size"),
        F.col("username").rlike("(?i)bot").alias("bot"),
        F.concat("user_id", F.lit("@"), F.col("article_id").cast("string")).alias("tag"),
    )


@query(
    "date_functions",
    uses="monthly",
    sql="""SELECT user_id, article_id, "timestamp", CAST(month("timestamp") AS INT) AS month,
      CAST(dayofyear("timestamp") AS INT) AS doy, strftime("timestamp", '%Y-%m-%d') AS day,
      CAST(floor(epoch("timestamp")) AS BIGINT) AS seconds, CAST(date_diff('day', DATE '2024-01-01', "timestamp"::DATE) AS INT) AS age,
      CAST("timestamp" + INTERVAL 93 DAY AS DATE) AS later FROM monthly""",
)
def date_functions(spark, folder):
    ts = F.col("timestamp")
    return W.monthly_edits(spark, folder).select(
        "user_id",
        "article_id",
        "timestamp",
        F.month(ts).alias("month"),
        F.dayofyear(ts).alias("doy"),
        F.date_format(ts, "yyyy-MM-dd").alias("day"),
        F.unix_timestamp(ts).alias("seconds"),
        F.datediff(ts, F.lit("2024-01-01").cast("date")).alias("age"),
        F.to_date(ts + F.expr("INTERVAL 93 DAYS")).alias("later"),
    )


@query(
    "conditional_functions",
    uses="edits",
    sql="""SELECT rev_id, article_id, CASE WHEN textdata > 1000 THEN 'big' WHEN textdata < 20 THEN 'small' ELSE 'plain' END AS kind,
      coalesce(TRY_CAST(user_id AS BIGINT), -1) AS known_user, TRY_CAST(user_id AS BIGINT) IS NULL AS anonymous FROM edits""",
)
def conditional_functions(spark, folder):
    words, number = F.col("textdata"), F.col("user_id").try_cast("bigint")
    return plain_edits(spark, folder).select(
        "rev_id",
        "article_id",
        F.when(words > 1000, "big").when(words < 20, "small").otherwise("plain").alias("kind"),
        F.coalesce(number, F.lit(-1)).alias("known_user"),
        number.isNull().alias("anonymous"),
    )


@query(
    "array_functions",
    uses="vectors",
    sql="""SELECT user_id, CAST(len(vec) AS INT) AS size, round(vec[1], 6) AS first, round(list_sum(vec), 6) AS total,
      round(list_max(vec), 6) AS top, CAST(list_position(vec, list_max(vec)) - 1 AS INT) AS label FROM vectors""",
)
def array_functions(spark, folder):
    vec = F.col("vec")
    return W.role_vectors(spark, folder).select(
        "user_id",
        F.size(vec).alias("size"),
        F.round(vec.getItem(0), 6).alias("first"),
        F.round(C.vector_sum(vec), 6).alias("total"),
        F.round(F.array_max(vec), 6).alias("top"),
        C.arg_max(vec).alias("label"),
    )
