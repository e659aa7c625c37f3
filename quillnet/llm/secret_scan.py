"""Secrets in texts by a trigram inverted index, in built-in expressions only.

From each rule's pattern a Boolean query over trigrams is derived: an OR of ANDs of trigrams that every
match must contain. The index posts, for every trigram some query asks for, the texts that contain it.
Intersecting postings gives the candidate texts of each rule, and only those are scanned with the
pattern itself. Rules without mandatory trigrams scan every text. Texts are keyed by a 64-bit hash, so
equal texts are one posting; a hash collision can only add a candidate, which the pattern then judges.

Null texts count as empty and have no spans. Repeated rows each keep their row. Positions are code points.
Columns of the input are passed through; ``spans`` is replaced.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import let, query, table


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more are spans of ``kind``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


# The first three rules are the definition of the base spans. A run that has to reach a
# length on its own is written with the length in the pattern, which finds the same runs.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

MOST_ALTERNATIVES = 64
WIDEST_CLASS = 8


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, each a set of lower-case trigrams that a match must contain; None if some match needs none.

    Alternatives are followed through groups, branches, optional items and small character classes.
    Anything else ends the literal run, which only weakens the query.
    """
    found = _walk(parser.parse(pattern), [(frozenset(), "")])
    if found is None:
        return None
    sets = {grams | _grams(run) for grams, run in found}
    if not all(sets):
        return None
    return sorted((s for s in sets if not any(other < s for other in sets)), key=sorted)


def _grams(run: str) -> frozenset[str]:
    run = run.lower()
    return frozenset(run[i : i + 3] for i in range(len(run) - 2))


def _walk(items: Iterable, states: list[tuple[frozenset[str], str]]) -> list[tuple[frozenset[str], str]] | None:
    stop = lambda states: [(grams | _grams(run), "") for grams, run in states]
    for op, value in items:
        if op is ops.LITERAL:
            states = [(grams, run + chr(value)) for grams, run in states]
        elif op is ops.SUBPATTERN:
            states = _walk(value[-1], states)
        elif op is ops.BRANCH:
            branches = [_walk(branch, states) for branch in value[1]]
            states = None if None in branches else [state for branch in branches for state in branch]
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            low, high, body = value
            once = _walk(body, states)
            if low == 0:
                states = None if once is None else states + (once if high == 1 else stop(once))
                if high != 1 and states is not None:
                    states = stop(states)
            else:
                states = once if once is None or (low, high) == (1, 1) else stop(once)
        elif op is ops.IN and all(o is ops.LITERAL for o, _ in value) and len(value) <= WIDEST_CLASS:
            states = [(grams, run + chr(c)) for grams, run in states for _, c in value]
        else:
            states = stop(states)
        if states is None:
            return None
        states = list(dict.fromkeys(states))
        if len(states) > MOST_ALTERNATIVES:
            states = list(dict.fromkeys(stop(states)))
            if len(states) > MOST_ALTERNATIVES:
                return None
    return states


def postings(docs: DataFrame, trigrams: Sequence[str], text: str = "text") -> DataFrame:
    """The index: (trigram, key) for each of ``trigrams`` and each text that contains it in any case."""
    grams = F.array(*[F.lit(g) for g in trigrams])
    body = F.coalesce(F.col(text), F.lit(""))
    inside = let(F.lower(body), lambda low: F.filter(grams, lambda g: F.contains(low, g)))
    return docs.select(F.xxhash64(body).alias("key"), F.explode(inside).alias("trigram"))


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(key, kinds): the kinds whose trigram query holds for a text, by intersecting postings."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    grams = sorted({g for q in queries.values() if q for alternative in q for g in alternative})
    slot = {g: k for k, g in enumerate(grams)}
    words = len(grams) // 60 + 1
    bit = F.create_map(*[F.lit(v) for g in grams for v in (g, slot[g])]) if grams else None
    if bit is None:
        return index.select("key", F.array().cast("array<string>").alias("kinds")).limit(0)
    posted = index.withColumn("slot", F.element_at(bit, F.col("trigram")))
    # One bit per trigram: OR-ing the postings of a text leaves the set of trigrams it has.
    masks = [
        F.bit_or(
            F.when(F.floor(F.col("slot") / 60) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 60).cast("int")))
            .otherwise(F.lit(0).cast("long"))
        ).alias(f"m{w}")
        for w in range(words)
    ]

    def holds(alternative: frozenset[str]) -> Column:
        test = F.lit(True)
        for w in range(words):
            need = sum(1 << (slot[g] % 60) for g in alternative if slot[g] // 60 == w)
            if need:
                test = test & (F.col(f"m{w}").bitwiseAND(F.lit(need).cast("long")) == need)
        return test

    kinds = []
    for kind, q in queries.items():
        if q:
            test = F.lit(False)
            for alternative in q:
                test = test | holds(alternative)
            kinds.append(F.when(test, F.lit(kind)))
    found = F.array_compact(F.array(*kinds)) if kinds else F.array().cast("array<string>")
    return posted.groupBy("key").agg(*masks).select("key", found.alias("kinds")).filter(F.size("kinds") > 0)


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches of one rule as structs (start, rank, end, kind).

    The pieces between matches and the matches alternate, so their lengths give the positions.
    """
    pattern = F.lit(rule.java)
    parts = F.struct(
        F.split(text, rule.java, -1).alias("gaps"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )
    span = "struct<start:bigint,rank:int,end:bigint,kind:string>"
    empty = F.array().cast(f"array<{span}>")

    def step(p: Column):
        def add(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(p["gaps"], i)).cast("long")
            end = start + F.length(F.get(p["whole"], i)).cast("long")
            one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            long_enough = F.length(F.get(p["value"], i)) >= rule.least
            spans = F.when(long_enough, F.concat(acc["spans"], F.array(one))).otherwise(acc["spans"])
            return F.struct(end.alias("at"), spans.alias("spans"))

        return add

    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))
    walked = let(
        parts,
        lambda p: F.aggregate(
            F.sequence(F.lit(0), F.size(p["whole"]) - 1), start.cast(f"struct<at:bigint,spans:array<{span}>>"), step(p), lambda acc: acc["spans"]
        ),
    )
    return F.when(text.rlike(rule.java), walked).otherwise(empty)


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: all matches of ``rules`` by start, then in the order of the rules."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    grams = sorted({g for q in queries.values() if q for alternative in q for g in alternative})
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.drop("spans").withColumn("_key", F.xxhash64(body))
    if grams:
        likely = candidates(postings(docs, grams, text), rules)
        rows = rows.join(likely.select(F.col("key").alias("_key"), F.col("kinds").alias("_kinds")), "_key", "left")
    else:
        rows = rows.withColumn("_kinds", F.lit(None).cast("array<string>"))
    asked = F.coalesce(F.col("_kinds"), F.array().cast("array<string>"))
    found = []
    for rank, rule in enumerate(rules):
        spans = matches(body, rule, rank)
        if queries[rule.kind]:
            none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
            spans = F.when(F.array_contains(asked, rule.kind), spans).otherwise(none)
        found.append(spans)
    return rows.withColumn("spans", F.array_sort(F.concat(*found))).drop("_key", "_kinds")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every maximal run of overlapping spans replaced by its first kind in brackets.

    Reads ``spans`` in order; between them the text is copied.
    """
    text = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        shown = F.concat(acc["parts"], F.array(gap, F.concat(F.lit("["), s["kind"], F.lit("]"))))
        parts = F.when(s["start"] < acc["at"], acc["parts"]).otherwise(shown)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    rest = lambda acc: F.concat(
        F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))
    )
    walked = F.aggregate(spans, start.cast("struct<at:bigint,parts:array<string>>"), add, rest)
    return F.when(F.size(spans) > 0, walked).otherwise(text)


def oracle(rules: Sequence[Rule]) -> str:
    """The same spans in DuckDB, every rule scanning every text; base runs are cut by length after matching."""
    plain = {"access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}
    arms = []
    for rank, rule in enumerate(rules):
        pattern, group, least = plain.get(rule.kind, (rule.java, rule.group, rule.least))
        quoted = pattern.replace("'", "''")
        arms.append(
            f"""SELECT k, {rank} AS rank, '{rule.kind}' AS kind, {least} AS least, string_split_regex(text, '{quoted}') AS gaps,
            regexp_extract_all(text, '{quoted}') AS whole, regexp_extract_all(text, '{quoted}', {group}) AS value FROM docs"""
        )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(arms)}),
steps AS (SELECT k, rank, kind, least, i, gaps[i] AS gap, whole[i] AS whole, value[i] AS value
  FROM found, unnest(generate_series(1, len(whole))) AS t(i)),
placed AS (SELECT k, rank, kind, length(value) >= least AS good,
  sum(length(gap) + length(whole)) OVER (PARTITION BY k, rank ORDER BY i) AS "end", length(whole) AS n FROM steps),
spans AS (SELECT k, rank, kind, concat_ws(':', kind, CAST("end" - n AS BIGINT), CAST("end" AS BIGINT)) AS s, "end" - n AS start
  FROM placed WHERE good),
per AS (SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, string_agg(s, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
  string_agg(s, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN per USING (k)"""


@query("op7_secret_scan", oracle(RULES))
def secret_query(spark, folder):
    found = scan(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(rule.kind) for rule in BASE],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
