"""Conversations as training text with token-aligned loss masks.

A conversation is rendered whole: per turn a turn marker, the role, a body marker, the text and an end marker.
Markers are special tokens, so no token reaches over one. Inside roles and texts every ``<`` before ``|``,
with any backslashes between, gets one more backslash, so no marker can be forged and the
step can be undone. The rendered text is encoded once with offsets; the spans of the trained roles' texts and
the token spans are both sorted, and a binary search gives the tokens inside each span: the loss mask.

Turns are taken in order of turn (nulls first), then role and text. Null roles and texts are empty; a null
conv_id is a conversation of its own; repeated rows are turns of their own. A conversation above ``part_chars`` is
cut at turns into consecutive parts, so memory stays bounded. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import query, table

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
MARKERS = (TURN, BODY, END)
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: Sequence[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted text and the spans [start, end) of the turns' texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    found = re.findall(r"<\|turn\|>(.*?)<\|body\|>(.*?)<\|end\|>", text, re.S)
    return [(unescape(role), unescape(body)) for role, body in found]


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets keep their blanks
    tokenizer.add_special_tokens([AddedToken(marker, normalized=False, special=True) for marker in MARKERS])
    return tokenizer


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for tokens that lie inside one of the sorted ``spans``."""
    mask = np.zeros(len(starts), bool)
    first = np.searchsorted(starts, spans[:, 0])
    last = np.searchsorted(ends, spans[:, 1], side="right")
    for a, b, (start, end) in zip(first, last, spans):
        if start < end:
            mask[a:b] = True
    return mask


def loss_text(text: str, starts: Sequence[int], ends: Sequence[int], mask: Sequence[bool]) -> list[str]:
    """The unescaped text under the mask, one entry per run of characters."""
    runs: list[list[int]] = []
    for start, end in zip(np.asarray(starts)[mask], np.asarray(ends)[mask]):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], int(end))
        else:
            runs.append([int(start), int(end)])
    return [unescape(text[a:b]) for a, b in runs]


FORMATTED = "conv string, part long, n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def formatting(path: str, trained: frozenset[str], part_chars: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load_tokenizer(path)
        rows, size = [], 0

        def finish(conv: str, part: int, turns: list[tuple[str, str]]) -> None:
            text, spans = render(turns)
            coded = tokenizer.encode(text, add_special_tokens=False)
            starts, ends = np.array(coded.offsets, np.int64).reshape(-1, 2).T
            mask = loss_mask(starts, ends, spans[[role in trained for role, _ in turns]])
            rows.append((conv, part, len(turns), text, coded.ids, starts.astype(np.int32), ends.astype(np.int32), mask))

        conv, part, turns, chars = None, 0, [], 0
        for frame in frames:
            for key, role, text in zip(frame["conv"], frame["role"], frame["text"]):
                if turns and (key != conv or chars >= part_chars):
                    finish(conv, part, turns)
                    size += chars
                    part, turns, chars = part + 1, [], 0
                if key != conv:
                    conv, part = key, 0
                turns.append((role, text))
                chars += len(role) + len(text)
                if size >= part_chars:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows.clear()
                    size = 0
        if turns:
            finish(conv, part, turns)
        if rows:
            yield pd.DataFrame(rows, columns=COLUMNS)

    return run


COLUMNS = [field.split()[0] for field in FORMATTED.split(", ")]


def format_chats(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained: Sequence[str] = ("assistant",),
    tokenizer: str = TOKENIZER,
    part_chars: int = 1_000_000,
) -> DataFrame:
    """FORMATTED rows: parts of conversations in order; ``conv`` is the id as text, empty for null."""
    rows = turns.select(
        F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInPandas(formatting(tokenizer, frozenset(trained), part_chars), FORMATTED)


DIGESTS = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per conversation, figures read back from the formatted parts, which arrive in order."""
    conv, turns, loss, counts = None, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

    def row() -> tuple:
        return conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

    for frame in frames:
        rows = []
        for part in frame.itertuples(index=False):
            if part.conv != conv:
                if conv is not None:
                    rows.append(row())
                conv, turns, loss, counts = part.conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            for role, text in parse(part.formatted):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                counts[0] += 1
            for text in loss_text(part.formatted, part.starts, part.ends, part.loss):
                loss.update(text.encode("utf-8", "surrogatepass"))
                counts[1] += len(text)
            counts[2] += len(part.formatted)
        if rows:
            yield pd.DataFrame(rows, columns=[field.split()[0] for field in DIGESTS.split(", ")])
    if conv is not None:
        yield pd.DataFrame([row()], columns=[field.split()[0] for field in DIGESTS.split(", ")])


@query("op4_chat_format")
def chat_query(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    forged = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    found = format_chats(turns.union(forged)).mapInPandas(digests, DIGESTS)
    return found.select(F.when(F.col("conv") != "", F.col("conv").cast("long")).alias("conv_id"), *found.columns[1:])
