"""Quality rules as a short-circuit cascade, in built-in expressions only.

Every rule is an expression over a document. Its cost and its share of rejections are estimated on a
sample, the rules are ordered by rejections per unit of cost, and one CASE expression evaluates them in
that order: the first rule that rejects a document ends its evaluation. The order changes only the
time and which of several failing rules is named; ``kept`` is the same in any order.

Null and empty texts have no words and are rejected by ``few_words``. Repeated rows are judged alike.
An empty table gives no rows. Columns of the input are passed through; ``rejected_by`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import SPACE, WORD, let, query, table

Features = Mapping[str, Column]


def features(text: Column) -> dict[str, Column]:
    """The measures rules are made of, each an expression of its own so that it is only computed when asked for."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    kept = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": kept(r"[^#*$%&|<>]+"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long"),
        "n_repeat_words": repeated_words(words),
        "n_upper": kept(r"[^A-Z]+"),
        "n_letters": kept(r"[^A-Za-z]+"),
    }


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text.

    Windows are compared by 64-bit hashes of word hashes. Only texts with a repeated window sort them.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(
        hashes,
        lambda h: F.when(
            F.size(h) >= width,
            F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )

    def covered(found: Column) -> Column:
        order = F.array_sort(F.transform(found, lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i"))))
        twice = let(
            order,
            lambda s: F.filter(
                s, lambda e, i: (F.get(s, i - 1)["x"].eqNullSafe(e["x"])) | (F.get(s, i + 1)["x"].eqNullSafe(e["x"]))
            ),
        )
        starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(-width).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(
                i.alias("last"), (acc["n"] + F.least(F.lit(width).cast("long"), i - acc["last"])).alias("n")
            ),
            lambda acc: acc["n"],
        )

    return let(
        windows,
        lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(covered(found)),
    )


@dataclass(frozen=True)
class Rule:
    """``rejects`` from the features; ``work`` is what it costs, in passes over characters and words."""

    name: str
    rejects: Callable[[Features], Column]
    char_passes: float
    word_passes: float = 0.0


RULES = (
    Rule("few_words", lambda f: f["n_words"] < 10, 1, 1),
    Rule("repeated_words", lambda f: 100 * f["n_repeat_words"] > 20 * f["n_words"], 2, 12),
    Rule("symbols", lambda f: 100 * f["n_symbols"] > 30 * f["n_words"], 2, 1),
    Rule("repeated_lines", lambda f: 2 * f["n_dup_lines"] > f["n_lines"], 2),
    Rule("capitals", lambda f: 100 * f["n_upper"] > 60 * f["n_letters"], 2),
)


def order_rules(
    docs: DataFrame, rules: Sequence[Rule], found: Features, text: str = "text", sample_rows: int = 5_000, seed: int = 7
) -> list[Rule]:
    """Rules by rejections per unit of cost on a sample of about ``sample_rows`` documents, best first.

    The sample only decides the order. Ties and empty samples keep the given order.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    chars = F.coalesce(F.length(text), F.lit(0))
    estimates = []
    for k, rule in enumerate(rules):
        estimates.append(F.avg(F.when(rule.rejects(found), 1.0).otherwise(0.0)).alias(f"hit{k}"))
    row = docs.sample(share, seed).agg(F.avg(chars).alias("chars"), F.avg(chars / 6.0).alias("words"), *estimates).first()
    cost = lambda rule: 1.0 + rule.char_passes * (row["chars"] or 0.0) + rule.word_passes * (row["words"] or 0.0)
    gain = {rule.name: (row[f"hit{k}"] or 0.0) / cost(rule) for k, rule in enumerate(rules)}
    return sorted(rules, key=lambda rule: -gain[rule.name])


def cascade(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    text: str = "text",
    found: Features | None = None,
    sample_of: DataFrame | None = None,
    **sampling,
) -> DataFrame:
    """``docs`` with ``rejected_by``: the first rule in cascade order that rejects the document, else null.

    ``found`` names columns of ``docs`` that already hold the features; the sample is then taken from
    ``sample_of``, the documents before they were measured.
    """
    ordered = order_rules(docs if sample_of is None else sample_of, rules, features(F.col(text)), text, **sampling)
    found = found or features(F.col(text))
    verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        verdict = F.when(rule.rejects(found), F.lit(rule.name)).otherwise(verdict)
    return docs.withColumn("rejected_by", verdict)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM docs),
wins AS (SELECT k, i, array_to_string(w[i:i+4], ' ') AS g FROM split, unnest(generate_series(1, len(w) - 4)) AS t(i)),
twice AS (SELECT *, count(*) OVER (PARTITION BY k, g) AS c FROM wins),
covered AS (SELECT k, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(generate_series(0, 4)) AS j) WHERE c > 1 GROUP BY k),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters FROM split LEFT JOIN covered USING (k)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 2 * n_dup_lines > n_lines OR 100 * n_upper > 60 * n_letters) AS kept
FROM v"""


@query("op8_quality_rules", ORACLE)
def quality_query(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    measures = features(F.col("text"))
    measured = docs.select("*", *[column.alias(name) for name, column in measures.items()])
    judged = cascade(measured, found={name: F.col(name) for name in measures}, sample_of=docs)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select(
        "doc_id", *MEASURES, failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept")
    )
