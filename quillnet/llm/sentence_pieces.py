"""SentencePiece encoding and decoding of texts of any length by a max-plus scan.

The vocabulary file is a BPE model with byte fallback. Its encoding of a text is one path through the lattice of
pieces, and a path is that encoding exactly if every two neighbouring pieces are what their joined text encodes to. So
the weight of a step is 0 if the two pieces may stand side by side and minus infinity if not, and the encoding
is the only path of weight 0.

A document above ``chunk_chars`` is cut into chunks at fixed places, whatever is there. A state at a border is a piece that
covers the character before it. Each chunk yields the matrix of best weights from its states on the left to
those on the right; matrices are combined associatively by max-plus products, which leaves one state at each
border; then each chunk recovers its own pieces between its two states. Chunks are rows and matrices are small,
so no task holds more than a chunk while pieces are sought; the ids of a document are one row again in the end, as its text was.

Inside a chunk, places that no piece of the vocabulary can cover (most blanks, unknown characters) separate
the text; segments between them are encoded on their own, unseen ones of a batch together in numpy, and remembered.

Ids are those of the sentencepiece library, but for U+2581: there it would come back as a blank, here it goes by its
bytes, so decoding gives every text back exactly. Null texts count as empty and have no ids. Repeated rows are encoded
alike (giant texts once). An empty table gives no rows. Columns pass through; ``ids`` is replaced.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import State, by_group, query, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Segments and pairs remembered by a worker, and characters it looks at together: both bound its memory.
REMEMBERED = 100_000
CHARS_TOGETHER = 500_000
TOGETHER = 24
BLANK = "▁"


class Pieces:
    """The pieces of a model, with blanks as blanks."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        plain = [k for k in range(count) if not (model.is_unknown(k) or model.is_control(k) or model.is_byte(k) or model.is_unused(k))]
        self.text = {k: model.id_to_piece(k).replace(BLANK, " ") for k in plain}
        self.id = {piece: k for k, piece in self.text.items()}
        self.rank = np.full(count, np.inf)
        self.rank[plain] = [-model.get_score(k) for k in plain]
        self.byte = {int(model.id_to_piece(k)[1:-1], 16): k for k in range(count) if model.is_byte(k)}
        self.raw = [b""] * count
        for k, piece in self.text.items():
            self.raw[k] = piece.encode()
        for value, k in self.byte.items():
            self.raw[k] = bytes([value])
        self.raw_of = np.array([*self.raw, None], object)[:-1]
        self.longest = max(map(len, self.id))
        self.count = count
        pairs = []
        for piece, k in self.id.items():
            for cut in range(1, len(piece)):
                a, b = self.id.get(piece[:cut]), self.id.get(piece[cut:])
                if a is not None and b is not None:
                    pairs.append((a * count + b, k))
        pairs.sort()
        self.pair_keys = np.array([p[0] for p in pairs], np.int64)
        self.pair_ids = np.array([p[1] for p in pairs], np.int64)
        self.pairs = dict(pairs)
        letters = sorted({c for piece in self.id for c in piece})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        # The piece of each letter, -1 for letters without one.
        self.alone = np.array([-1, *(self.id.get(c, -1) for c in letters)], np.int64)
        self.inside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for piece in self.id:
            where = self.letter[[ord(c) for c in piece]]
            self.inside[where[:-1], where[1:]] = True
        # Packed ids of segments; the older half is dropped when the newer one is full.
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.side: dict[tuple[int, int], bool] = {}

    def start_ids(self, text: str) -> list[int]:
        out: list[int] = []
        for c in text:
            k = self.id.get(c)
            out += [k] if k is not None else [self.byte[b] for b in c.encode("utf-8", "surrogatepass")]
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """Merges of lowest rank first, leftmost of equal ones, with a heap."""
        after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
        heap: list[tuple] = []

        def offer(i: int, j: int) -> None:
            k = self.pairs.get(ids[i] * self.count + ids[j])
            if k is not None:
                heapq.heappush(heap, (self.rank[k], i, j, ids[i], ids[j], k))

        for i in range(len(ids) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b, k = heapq.heappop(heap)
            if not (alive[i] and alive[j] and ids[i] == a and ids[j] == b and after[i] == j):
                continue
            ids[i], alive[j], after[i] = k, False, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [k for k, kept in zip(ids, alive) if kept]

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ids of pairs, -1 where there are none."""
        key = np.where((a < 0) | (b < 0), -1, a * self.count + b)
        place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[place] == key, self.pair_ids[place], -1)

    def start_together(self, segments: Sequence[str]) -> np.ndarray:
        """``start_ids`` of many short segments, one row each, filled up with -1."""
        code = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        start = self.alone[self.letter[code]]
        length = np.fromiter(map(len, segments), np.int64, len(segments))
        owner = np.repeat(np.arange(len(segments)), length)
        # Letters without a piece are several bytes: their segments are laid one by one.
        spelled = {int(k): self.start_ids(segments[k]) for k in np.unique(owner[start < 0])}
        ids = np.full((len(segments), max(int(length.max()), max(map(len, spelled.values()), default=0)) + 1), -1, np.int64)
        ids[owner, np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)] = start
        for k, row in spelled.items():
            ids[k, : len(row)] = row
        return ids

    def merge_together(self, segments: Sequence[str]) -> list[bytes]:
        """The same merges for many short segments in step."""
        ids = self.start_together(segments)
        rows, width = ids, ids.shape[1] - 1
        merged = self.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width)
        merged = np.column_stack([merged, np.full(len(rows), -1)])
        rank = np.where(merged >= 0, self.rank[merged], np.inf)
        active = np.arange(len(rows))
        spread = np.arange(width + 1)
        while True:
            best = rank[active].argmin(axis=1)
            some = np.isfinite(rank[active, best])
            active, best = active[some], best[some]
            if not len(active):
                break
            here = np.arange(len(active))
            moved = np.minimum(spread + (spread > best[:, None]), width)
            sub, sub_rank, sub_merged = ids[active], rank[active], merged[active]
            new = sub_merged[here, best]
            sub = np.take_along_axis(sub, moved, 1)
            sub_rank, sub_merged = np.take_along_axis(sub_rank, moved, 1), np.take_along_axis(sub_merged, moved, 1)
            sub[here, best] = new
            for at in (best - 1, best):
                at_safe = np.maximum(at, 0)
                left, right = sub[here, at_safe], sub[here, np.minimum(at_safe + 1, width)]
                found = np.where(at < 0, -1, self.look_up(left, right))
                use = at >= 0
                sub_merged[here[use], at_safe[use]] = found[use]
                sub_rank[here[use], at_safe[use]] = np.where(found[use] >= 0, self.rank[found[use]], np.inf)
            ids[active], rank[active], merged[active] = sub, sub_rank, sub_merged
        lengths = (ids >= 0).sum(axis=1).tolist()
        return [row[:n].tobytes() for row, n in zip(ids.astype(np.int32), lengths)]

    def learn(self, segments: set[str]) -> None:
        short: dict[int, list[str]] = {}
        for segment in segments:
            if len(segment) <= TOGETHER:
                short.setdefault(-(-len(segment) // 6), []).append(segment)
            else:
                self.seen[segment] = np.array(self.merge(self.start_ids(segment)), np.int32).tobytes()
        for group in short.values():
            self.seen.update(zip(group, self.merge_together(group)))

    def encode_plain(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of texts as they are, without the blank in front."""
        out: list[np.ndarray] = []
        first = chars = 0
        for k, text in enumerate(texts):
            chars += len(text)
            if chars >= CHARS_TOGETHER or k == len(texts) - 1:
                out += self.encode_few(texts[first : k + 1])
                first, chars = k + 1, 0
        return out

    def encode_few(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of some texts, cut wherever no piece can lie across; equal segments are looked up once."""
        whole = "".join(texts)
        if not whole:
            return [np.empty(0, np.int32) for _ in texts]
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[code]
        text_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        border = np.ones(len(code) + 1, bool)
        border[1:-1] = ~self.inside[letter[:-1], letter[1:]]
        border[text_end] = True
        place = np.flatnonzero(border)
        which, segments = distinct_segments(whole, code, place[:-1], np.diff(place))
        known = self.ids_of(segments)
        flat = np.frombuffer(b"".join(known), np.int32)
        length = np.fromiter(map(len, known), np.int64, len(known)) // 4
        taken = length[which]
        stop = np.cumsum(taken)
        ids = flat[np.repeat((np.cumsum(length) - length)[which] - (stop - taken), taken) + np.arange(stop[-1])]
        ends = np.append(0, stop)[np.searchsorted(place, text_end)]
        return np.split(ids, ends[:-1])

    def ids_of(self, segments: Sequence[str]) -> list[bytes]:
        """Packed ids of distinct segments, learnt where they are not remembered."""
        if len(self.seen) > REMEMBERED:
            self.seen, self.older = {}, self.seen
        seen, older = self.seen, self.older
        unseen = {s for s in segments if s not in seen}
        seen.update((s, older[s]) for s in unseen if s in older)
        self.learn({s for s in unseen if s not in seen})
        return [seen[s] for s in segments]

    def beside(self, a: int, b: int) -> bool:
        """Whether two pieces may stand side by side."""
        known = self.side.get((a, b))
        if known is None:
            if len(self.side) > REMEMBERED:
                self.side.clear()
            known = self.side[a, b] = self.merge(self.start_ids(self.text[a] + self.text[b])) == [a, b]
        return known

    def covering(self, text: str, border: int) -> list[tuple[int, int, int]]:
        """Pieces (start, end, id) that cover the character before ``border``; byte runs of unknown characters as id -1."""
        out = []
        for start in range(max(0, border - self.longest), border):
            for end in range(border, min(len(text), start + self.longest) + 1):
                k = self.id.get(text[start:end])
                if k is not None:
                    out.append((start, end, k))
        if text[border - 1] not in self.id:
            out.append((border - 1, border, -1))
        return out

    def decode(self, ids: Sequence[int]) -> str:
        text = b"".join(self.raw_of[np.asarray(ids, np.int64)].tolist()).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


def distinct_segments(whole: str, code: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """For each segment of a text the number of its value, and the values: by hash, confirmed letter by letter."""
    inside = np.arange(len(code)) - np.repeat(start, length)
    hashed = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    hashed = (hashed ^ (hashed >> np.uint64(29))) * np.cumprod(np.full(int(length.max()), 0xBF58476D1CE4E5B9, np.uint64))[inside]
    _, first, which = np.unique(np.add.reduceat(hashed, start), return_index=True, return_inverse=True)
    alike = first[which]
    if (length == length[alike]).all() and (code == code[np.repeat(start[alike], length) + inside]).all():
        begin = start[first]
        return which, list(map(whole.__getitem__, map(slice, begin.tolist(), (begin + length[first]).tolist())))
    number: dict[str, int] = {}
    which = [number.setdefault(whole[a : a + n], len(number)) for a, n in zip(start.tolist(), length.tolist())]
    return np.array(which), list(number)


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product, which is associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


NEVER = -np.inf


def transfer(model: Pieces, text: str, left: int, right: int, first: bool, last: bool) -> tuple[list, list, np.ndarray]:
    """States at both borders of text[left:right] and the best weights between them.

    ``text`` reaches ``longest`` characters beyond the borders where the document does. The first border of a document
    has the one state None, and so has the last. Sets of states are carried as bits, all states at once.
    """
    ins = [None] if first else model.covering(text, left)
    outs = [None] if last else model.covering(text, right)
    matrix = np.full((len(ins), len(outs)), NEVER)
    ends: dict[int, dict] = {}
    for bit, state in enumerate(ins):
        at, k = (left, None) if state is None else (state[1], state[2])
        row = ends.setdefault(at, {})
        row[k] = row.get(k, 0) | 1 << bit
    place = {state: k for k, state in enumerate(outs)}
    at = min(ends)
    while at < right or (last and at == right):
        arrived = ends.pop(at, {})
        if at == right:
            for bits in arrived.values():
                _mark(matrix, bits, 0)
            break
        if arrived:
            for end in range(at + 1, min(len(text), at + model.longest) + 1):
                k = model.id.get(text[at:end])
                if k is None:
                    continue
                bits = 0
                for before, mask in arrived.items():
                    if mask & ~bits and (model.beside(before, k) if before is not None and before >= 0 else _alone(model, k)):
                        bits |= mask
                if bits:
                    _arrive(ends, matrix, place, at, end, k, bits, right, last)
            if text[at] not in model.id:
                bits = functools.reduce(int.__or__, arrived.values())
                _arrive(ends, matrix, place, at, at + 1, -1, bits, right, last)
        at += 1
    return ins, outs, matrix


def _alone(model: Pieces, k: int) -> bool:
    known = model.side.get((k, -1))
    if known is None:
        known = model.side[k, -1] = model.merge(model.start_ids(model.text[k])) == [k]
    return known


def _arrive(ends, matrix, place, at, end, k, bits, right, last) -> None:
    if end >= right and not last:
        _mark(matrix, bits, place[at, end, k])
    elif end <= right:
        row = ends.setdefault(end, {})
        row[k] = row.get(k, 0) | bits


def _mark(matrix: np.ndarray, bits: int, column: int) -> None:
    for row in range(len(matrix)):
        if bits >> row & 1:
            matrix[row, column] = 0.0


def shortcut(model: Pieces, text: str, left: int, right: int, first: bool, last: bool) -> tuple[list, list, np.ndarray]:
    """``transfer`` through two places that no piece covers, where there are any: all paths meet there."""
    code = model.letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    cut = np.flatnonzero(~model.inside[code[:-1], code[1:]]) + 1
    cut = cut[(cut >= left + (0 if first else model.longest)) & (cut <= right - model.longest)]
    if not len(cut):
        return transfer(model, text, left, right, first, last)
    a, b = int(cut[0]), int(cut[-1])
    ins, _, head = transfer(model, text[:a], left, a, first, True)
    _, outs, tail = transfer(model, text[b:], 0, right - b, True, last)
    outs = [None if s is None else (s[0] + b, s[1] + b, s[2]) for s in outs]
    return ins, outs, max_plus(head, tail)


def chunked(chunk_chars: int, longest: int):
    """Chunks of giant texts, each with the characters around it that its border states need."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text in zip(frame["key"], frame["text"]):
                text = " " + text
                count = -(-len(text) // chunk_chars)
                for chunk in range(count):
                    start = max(0, chunk * chunk_chars - longest)
                    body = text[start : (chunk + 1) * chunk_chars + longest]
                    left = chunk * chunk_chars - start
                    right = min(len(body), left + chunk_chars)
                    yield pd.DataFrame({"key": [key], "chunk": [chunk], "chunks": [count], "body": [body], "left": [left], "right": [right]})

    return run


CHUNK = "key string, chunk long, chunks long, body string, left long, right long"
MATRIX = "key string, chunk long, ins array<long>, outs array<long>, weights array<double>"


def packed(state: tuple[int, int, int] | None, border: int) -> int:
    """A state relative to its border as one number; -1 for the ends of a document."""
    return -1 if state is None else ((border - state[0]) << 40) | ((state[1] - border) << 32) | (state[2] + 1)


def matrices(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces(path)
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                ins, outs, matrix = shortcut(model, r.body, r.left, r.right, r.chunk == 0, r.chunk == r.chunks - 1)
                rows.append((r.key, r.chunk, [packed(s, r.left) for s in ins], [packed(s, r.right) for s in outs], matrix.ravel()))
            yield pd.DataFrame(rows, columns=["key", "chunk", "ins", "outs", "weights"])

    return run


def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per document: the state at every border, from products of the matrices before and after it."""
    for group in by_group(frames, "key"):
        group = group.sort_values("chunk")
        outs = [np.asarray(o) for o in group["outs"]]
        mats = [np.asarray(w).reshape(len(i), len(o)) for i, o, w in zip(group["ins"], outs, group["weights"])]
        before = list(itertools.accumulate(mats, max_plus))
        after = list(itertools.accumulate(reversed(mats), lambda b, a: max_plus(a, b)))[::-1]
        border = [-1]
        for k in range(len(mats) - 1):
            order = {s: i for i, s in enumerate(group["ins"].iat[k + 1])}
            follow = after[k + 1][[order[s] for s in outs[k]], 0]
            border.append(int(outs[k][np.argmax(before[k][0] + follow)]))
        yield pd.DataFrame({"key": group["key"], "chunk": group["chunk"], "enter": border, "leave": [*border[1:], -1]})


def backtrace(path: str):
    """Per chunk: the ids of the pieces that start in it, between its two states."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces(path)
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                start = r.left if r.enter < 0 else r.left + ((r.enter >> 32) & 0xFF)
                stop = r.right if r.leave < 0 else r.right - (r.leave >> 40)
                ids = model.encode_plain([r.body[start:stop]])[0].tolist()
                if r.leave >= 0:
                    k = (r.leave & 0xFFFFFFFF) - 1
                    ids += [k] if k >= 0 else model.start_ids(r.body[stop])
                rows.append((r.key, r.chunk, ids))
            yield pd.DataFrame(rows, columns=["key", "chunk", "ids"])

    return run


def encode_texts(path: str):
    def run(texts: pd.Series) -> pd.Series:
        model = pieces(path)
        return pd.Series(model.encode_plain([" " + t if t else "" for t in texts]), dtype=object)

    return run


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, chunk_chars: int = 32_768) -> DataFrame:
    """``docs`` with ``ids``, the piece ids of each whole text."""
    docs = docs.drop("ids")
    body = F.coalesce(F.col(text), F.lit(""))
    plain = F.pandas_udf(encode_texts(model), "array<int>")
    short = docs.filter(~giant(text, chunk_chars)).withColumn("ids", plain(body))
    return short.select(*docs.columns, "ids").union(encode_giants(docs, text, model, chunk_chars))


def giant(text: str, chunk_chars: int) -> Column:
    """Whether a text is cut into chunks."""
    if chunk_chars < 256:
        raise ValueError("chunks must be longer than any two pieces")
    return F.length(F.coalesce(F.col(text), F.lit(""))) > chunk_chars


def encode_giants(docs: DataFrame, text: str, model: str, chunk_chars: int) -> DataFrame:
    """The rows of ``docs`` with giant texts, with their ``ids``, by the scan over chunks."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.filter(giant(text, chunk_chars))
    texts = docs.select(F.md5(text).alias("key"), F.col(text).alias("text"))
    longest = pieces(model).longest
    chunks = texts.groupBy("key").agg(F.first("text").alias("text")).mapInPandas(chunked(chunk_chars, longest), CHUNK)
    chunks = State(chunks.repartition(parts, "key", "chunk"), "chunks").df
    found = chunks.mapInPandas(matrices(model), MATRIX).repartition(parts, "key").sortWithinPartitions("key")
    states = found.mapInPandas(solve, "key string, chunk long, enter long, leave long")
    traced = chunks.join(states, ["key", "chunk"]).select("key", "chunk", "body", "left", "right", "enter", "leave")
    traced = traced.mapInPandas(backtrace(model), "key string, chunk long, ids array<int>")
    whole = traced.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    whole = whole.select(F.col("key").alias("_key"), F.flatten(F.col("parts.ids")).alias("ids"))
    return docs.withColumn("_key", F.md5(text)).join(whole, "_key").select(*docs.columns, "ids")


def decoded(model: str = MODEL):
    """A pandas UDF from ids to text."""

    def run(ids: pd.Series) -> pd.Series:
        known = pieces(model)
        return pd.Series([known.decode(x) for x in ids], dtype=object)

    return F.pandas_udf(run, "string")


SUMMARY = "n_tokens long, ids_sha256 string, round_trip boolean"


def digest(known: Pieces, ids: np.ndarray, text: str) -> tuple[int, str, bool]:
    """The number of ids, their digest as little-endian 32-bit integers, and whether they decode to the text."""
    return len(ids), hashlib.sha256(np.asarray(ids, "<i4").tobytes()).hexdigest(), known.decode(ids) == text


def summaries(docs: DataFrame, text: str = "text", model: str = MODEL, chunk_chars: int = 32_768) -> DataFrame:
    """``docs`` with ``summary``: the digest of what ``encode`` gives each whole text, decoded again from these ids.

    Ids of short texts are digested in the task that encodes them and never leave it.
    """

    def straight(texts: pd.Series) -> pd.DataFrame:
        known = pieces(model)
        texts = [t or "" for t in texts]
        coded = known.encode_plain([" " + t if t else "" for t in texts])
        return pd.DataFrame([digest(known, ids, t) for ids, t in zip(coded, texts)], columns=DIGESTS)

    def after(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        known = pieces(model)
        return pd.DataFrame([digest(known, x, t) for x, t in zip(ids, texts)], columns=DIGESTS)

    docs = docs.drop("ids", "summary")
    short = docs.filter(~giant(text, chunk_chars)).withColumn("summary", F.pandas_udf(straight, SUMMARY)(F.col(text)))
    long = encode_giants(docs, text, model, chunk_chars).withColumn("summary", F.pandas_udf(after, SUMMARY)(F.col("ids"), F.col(text)))
    return short.select(*docs.columns, "summary").union(long.select(*docs.columns, "summary"))


DIGESTS = [field.split()[0] for field in SUMMARY.split(", ")]


@query("op10_sentence_pieces")
def pieces_query(spark, folder):
    return summaries(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "summary.*")
