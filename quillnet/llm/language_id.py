"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, runs of other characters than letters count as one blank, and n-grams of one to
``longest`` characters with a letter in them are hashed into ``slots``. Training counts n-grams per language in the
tasks and adds them up in Spark; the matrix of log-probabilities has slots times languages entries (at most
``most_langs``, checked), whatever the rows, and is broadcast. Batches are scored as a sparse matrix of counts times it.

Null texts and texts without a letter are ``und`` with score 0, as is every text where nothing was learned. Rows with a null
language or without letters teach nothing. Equal scores go to the first language by code point. Repeated rows are predicted alike. An
empty table gives no rows. Other columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import query, table

SLICE = 200_000


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_slots(text: str | None, slots: int, longest: int) -> Iterator[np.ndarray]:
    """Slots of the n-grams of a whole text, slice by slice; the end of a slice, as n-grams see it, leads the next."""
    low = (text or "").lower()
    tail, tail_known, after_letter = np.empty(0, np.uint64), np.empty(0, bool), False
    for at in range(0, len(low), SLICE):
        code = np.frombuffer(low[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        known = letters()[code]
        code = np.where(known, code, 0).astype(np.uint64)
        keep = known.copy()
        keep[1:] |= known[:-1]  # one blank after each word
        keep[0] |= after_letter
        after_letter = bool(known[-1])
        code, known = np.append(tail, code[keep]), np.append(tail_known, known[keep])
        fresh = len(tail)
        first = max(0, len(code) - longest + 1)
        tail, tail_known = code[first:], known[first:]
        hashed, some = np.zeros(len(code), np.uint64), np.zeros(len(code), bool)
        for n in range(1, longest + 1):
            m = len(code) - n + 1
            if m <= 0:
                break
            hashed = (hashed[:m] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            some = some[:m] | known[n - 1 :]
            mixed = (hashed ^ (hashed >> np.uint64(29))) % np.uint64(slots)
            inside = some.copy()
            inside[: max(0, min(fresh - n + 1, m))] = False
            yield mixed[inside].astype(np.int64)


def counted(text: str | None, slots: int, longest: int) -> np.ndarray:
    total = np.zeros(slots, np.int64)
    for found in gram_slots(text, slots, longest):
        total += np.bincount(found, minlength=slots)
    return total


def count_grams(slots: int, longest: int, most_langs: int):
    """Per language of a task: the documents (slot -1) and the n-grams in each slot."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                found = counted(text, slots, longest)
                if found.any():
                    if lang not in totals:
                        if len(totals) >= most_langs:
                            raise ValueError(f"more than {most_langs} languages")
                        totals[lang] = np.zeros(slots + 1, np.int64)
                    totals[lang][:-1] += found
                    totals[lang][-1] += 1
        for lang, total in totals.items():
            place = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "slot": np.where(place == slots, -1, place), "n": total[place]})

    return run


@dataclass(frozen=True)
class Model:
    langs: list[str]
    prior: np.ndarray
    logs: np.ndarray
    longest: int


def fit(rows: DataFrame, lang: str = "lang", text: str = "text", slots: int = 1 << 14, longest: int = 3, most_langs: int = 200, smoothing: float = 0.5) -> Model:
    known = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.mapInPandas(count_grams(slots, longest, most_langs), "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # One row per language and slot at most.
    found = counts.limit(most_langs * (slots + 1) + 1).toPandas()
    langs = sorted(found["lang"].unique(), key=lambda s: s.encode("utf-8", "surrogatepass"))
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    table = np.zeros((slots + 1, len(langs)))
    if len(langs):
        place = {name: k for k, name in enumerate(langs)}
        table[found["slot"].to_numpy(), found["lang"].map(place).to_numpy()] = found["n"].to_numpy()
    grams, docs = table[:-1], table[-1]
    logs = np.log(grams + smoothing) - np.log(grams.sum(axis=0) + smoothing * slots)
    return Model(langs, np.log(docs / max(1.0, docs.sum())) if len(langs) else docs, logs, longest)


def predictions(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Model = shared.value
        slots = len(model.logs)
        for frame in frames:
            slot, count, ends = [], [], []
            total = 0
            for text in frame["_text"]:
                found = counted(text, slots, model.longest)
                place = np.flatnonzero(found)
                slot.append(place)
                count.append(found[place])
                total += len(place)
                ends.append(total)
            some = np.array([len(s) > 0 for s in slot], bool) & bool(model.langs)
            lang, score = np.full(len(frame), "und", object), np.zeros(len(frame))
            if some.any():
                starts = np.array([0, *ends[:-1]])[some]
                products = model.logs[np.concatenate(slot)] * np.concatenate(count)[:, None]
                scores = np.add.reduceat(products, starts, axis=0) + model.prior
                best = scores.argmax(axis=1)
                odds = np.exp(scores - scores.max(axis=1, keepdims=True))
                lang[some] = np.array(model.langs, object)[best]
                score[some] = (odds.max(axis=1) / odds.sum(axis=1)).clip(0, 1)
            yield frame.drop(columns="_text").assign(lang_pred=lang, score=score)

    return run


def predict(rows: DataFrame, model: Model, key: str, text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row, from the text alone."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = rows.select(F.col(key).cast("string").alias(key), F.col(text).alias("_text"))
    found = kept.mapInPandas(predictions(shared), f"`{key}` string, lang_pred string, score double")
    return found.withColumn(key, F.col(key).cast(rows.schema[key].dataType))


@query("op6_language_id")
def language_query(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = lambda: F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    model = fit(docs.filter(~held()))
    found = predict(docs.select("doc_id", "text"), model, "doc_id")
    return found.select("doc_id", held().alias("held_out"), "lang_pred", "score")
