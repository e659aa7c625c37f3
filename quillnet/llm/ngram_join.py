"""Exact n-gram Jaccard join with signature trees.

A document is the set of its distinct ``width``-word shingles, as 64-bit hashes. Two documents link when
100 * intersection >= percent * union. The result is one row per document with its component.

1. Every shingle is posted once. Where a shingle has two owners or more, its owners learn so, with the
   shingle's rounded document frequency. A document of n shingles with fewer than percent% shared
   shingles cannot link and leaves here; the others keep their shared shingles only, since unshared
   ones never count in an intersection. Equal sets become one member.
2. Members that may link share one of their rarest shingles (the prefix filter, in one global order by
   frequency and hash). Components over these few shingles are the forests: no link leaves a forest.
3. Each forest is a signature tree: documents are leaves, ``fanout`` of them form an inner node, and
   about ``node_members`` of one size class form a root. A node holds the OR of its members' token bitmaps, its
   range of sizes and its largest number of tokens that share a bit. Roots of one forest are paired only
   where the size ranges allow a link and the bound allows it; a dual traversal then descends from
   pairs of roots to pairs of documents. The bound for two nodes is the number of common bits plus
   the smaller surplus of tokens over bits; pairs below the least intersection a link needs are pruned,
   as are nodes whose documents are known to be connected. Pairs of documents that are left are intersected.
4. Tasks return spanning links, at most one per document, and components join them.

Nothing is sampled or capped. A forest is never gathered: its roots are rows and pairs of roots are
tasks. Hashes are 64 bits (48 and a bucket while posted), so two different shingles are taken for one
with probability around 1e-13 per pair of documents compared.

Null and empty texts (or no words) have the empty set and are their own component. A null id is carried
and has a null component unless its text links it to others. Rows that share an id are one node.
Repeated rows and equal texts are in one component. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillnet.llm.common import State, by_group, components, query, table

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(UPPER, LOWER)
LOW48 = np.uint64((1 << 48) - 1)
CHUNK_TOKENS = 1_000_000
CACHED_WORDS = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), for arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    if not text:
        return np.empty(0, np.uint64)
    words = WORDS.findall(text.encode("utf-8", "surrogatepass").translate(FOLD))
    if not words:
        return np.empty(0, np.uint64)
    hashes = []
    for word in words:
        h = cache.get(word)
        if h is None:
            if len(cache) >= CACHED_WORDS:
                cache.clear()
            h = cache[word] = xxhash.xxh3_64_intdigest(word)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(min(width, len(h))):
        out = mix(out + h[k : k + n] * np.uint64(2 * k + 3))
    return np.unique(out)


def post(width: int, buckets: int):
    """Documents to chunks: per (chunk, bucket) the posted tokens, and per chunk its documents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[bytes, int] = {}
        task, serial = TaskContext.get().partitionId(), 0
        ids, sets, total = [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal serial, ids, sets, total
            chunk = (task << 32) | serial
            serial += 1
            sizes = np.array([len(s) for s in sets], np.int64)
            tokens = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            tokens, owner, bucket = tokens[order] & LOW48, owner[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket)) + 1
            rows = []
            for i, j in zip([0, *cut], [*cut, len(tokens)]):
                if j > i:
                    t = tokens[i:j]
                    body = (t & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (t >> np.uint64(32)).astype("<u2").tobytes()
                    rows.append((int(bucket[i]), chunk, body + owner[i:j].astype("<u2").tobytes(), None, None, None, None))
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            present = [x is not None for x in ids]
            rows.append((chunk % buckets, chunk, None, [x if ok else 0 for x, ok in zip(ids, present)], present, sizes.tolist(), prints))
            ids, sets, total = [], [], 0
            return pd.DataFrame(rows, columns=["bucket", "chunk", "tokens", "ids", "present", "sizes", "prints"])

        for frame in frames:
            for key, present, text in zip(frame["doc_id"].to_numpy(), frame["present"].to_numpy(), frame["text"]):
                found = shingles(text, width, cache)
                ids.append(int(key) if present else None)
                sets.append(found)
                total += len(found)
                if total >= CHUNK_TOKENS or len(sets) >= 60_000:
                    yield flush()
        if sets:
            yield flush()

    return run


def unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(body) // 8
    low = np.frombuffer(body, "<u4", n).astype(np.uint64)
    high = np.frombuffer(body, "<u2", n, 4 * n).astype(np.uint64)
    return low | high << np.uint64(32), np.frombuffer(body, "<u2", n, 6 * n)


def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per bucket: for each chunk, its tokens with two owners or more and their frequency class."""
    for group in by_group(frames, "bucket"):
        heads = group[group["tokens"].isna()]
        if len(heads):
            yield heads.assign(classes=None)
        group = group[group["tokens"].notna()]
        if not len(group):
            continue
        parts = [unpack(body) for body in group["tokens"]]
        tokens = np.concatenate([p[0] for p in parts])
        distinct, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
        top = np.uint64(int(group["bucket"].iat[0]) & 0xFFFF) << np.uint64(48)
        classes = np.minimum(255, np.ceil(4 * np.log2(count))).astype(np.uint8)
        rows, at = [], 0
        for (low, owner), chunk in zip(parts, group["chunk"]):
            where = place[at : at + len(low)]
            at += len(low)
            shared = count[where] > 1
            if shared.any():
                body = (low[shared] | top).astype("<u8").tobytes() + owner[shared].astype("<u2").tobytes()
                rows.append((0, int(chunk), body, None, None, None, None, classes[where[shared]].tobytes()))
        if rows:
            yield pd.DataFrame(rows, columns=["bucket", "chunk", "tokens", "ids", "present", "sizes", "prints", "classes"])


def gather(percent: int):
    """Per chunk: its documents, with the shared tokens (rarest first) of those that may link."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(frames, "chunk"):
            head = group[group["tokens"].isna()].iloc[0]
            rest = group[group["tokens"].notna()]
            sizes = np.asarray(head["sizes"], np.int64)
            ids, owners, classes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint8)]
            for body, level in zip(rest["tokens"], rest["classes"]):
                n = len(level)
                ids.append(np.frombuffer(body, "<u8", n))
                owners.append(np.frombuffer(body, "<u2", n, 8 * n).astype(np.int64))
                classes.append(np.frombuffer(level, np.uint8))
            token, owner, level = np.concatenate(ids), np.concatenate(owners), np.concatenate(classes)
            order = np.lexsort((token, level, owner))
            token, owner = token[order], owner[order]
            start = np.searchsorted(owner, np.arange(len(sizes) + 1))
            shared = np.diff(start)
            may = (sizes > 0) & (100 * shared >= percent * sizes)
            bodies = [token[start[k] : start[k + 1]].astype("<u8").tobytes() if may[k] else None for k in range(len(sizes))]
            yield pd.DataFrame(
                {
                    "doc_id": pd.array([int(x) if ok else None for x, ok in zip(head["ids"], head["present"])], "Int64"),
                    "n_shingles": sizes,
                    "print": list(head["prints"]),
                    "tokens": bodies,
                }
            )

    return run


def prefixes(percent: int):
    """(token, node) for the shared tokens among the first n - ceil(percent% n) + 1 of a member."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tokens, nodes = [], []
            for node, n, body in zip(frame["node"], frame["n_shingles"], frame["tokens"]):
                found = np.frombuffer(body, "<u8")
                reach = n - -(-percent * n // 100) + 1 - (n - len(found))
                if reach > 0:
                    tokens.append(found[:reach].view(np.int64))
                    nodes.append(np.full(min(reach, len(found)), node, np.int64))
            if tokens:
                yield pd.DataFrame({"token": np.concatenate(tokens), "node": np.concatenate(nodes)})

    return run


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 8, np.uint8)
    place = (mix(tokens) % np.uint64(bits)).astype(np.int64)
    np.bitwise_or.at(out, place >> 3, (1 << (place & 7)).astype(np.uint8))
    return out


def common_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a & b).sum(axis=-1, dtype=np.int64)


ROOT_BITS = 1 << 14


def roots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per root: its size range, the OR of its members' bitmaps and their largest surplus."""
    for group in by_group(frames, "root"):
        total, surplus = np.zeros(ROOT_BITS // 8, np.uint8), 0
        for body in group["tokens"]:
            found = np.frombuffer(body, "<u8")
            bits = bitmap(found, ROOT_BITS)
            surplus = max(surplus, len(found) - int(np.bitwise_count(bits).sum()))
            total |= bits
        sizes = group["n_shingles"]
        yield pd.DataFrame(
            {
                "forest": [group["forest"].iat[0]], "root": [group["root"].iat[0]], "class": [group["class"].iat[0]],
                "least": [sizes.min()], "most": [sizes.max()], "surplus": [surplus], "bits": [total.tobytes()],
            }
        )


def possible(percent: int):
    """Pairs of roots whose sizes and bitmaps allow a link."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for row in frame.itertuples(index=False):
                if row.root_a == row.root_b:
                    keep.append(True)
                    continue
                need = needed(max(row.least_a, -(-percent * row.least_b // 100)), max(row.least_b, -(-percent * row.least_a // 100)), percent)
                both = int(common_bits(np.frombuffer(row.bits_a, np.uint8), np.frombuffer(row.bits_b, np.uint8)))
                fits = 100 * row.most_a >= percent * row.least_b and 100 * row.most_b >= percent * row.least_a
                keep.append(bool(fits and both + min(row.surplus_a, row.surplus_b) >= need))
            yield frame.loc[keep, ["root_a", "root_b"]]

    return run


def needed(a, b, percent: int):
    """The least intersection of linked sets of sizes ``a`` and ``b``: the smallest i with 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


class Tree:
    """The lower levels below one root: documents by size, ``fanout`` to an inner node."""

    def __init__(self, group: pd.DataFrame, bits: int, fanout: int):
        group = group.sort_values(["n_shingles", "node"], kind="stable")
        self.node = group["node"].to_numpy()
        self.size = group["n_shingles"].to_numpy()
        self.tokens = [np.sort(np.frombuffer(body, "<u8")) for body in group["tokens"]]
        self.bits = np.stack([bitmap(t, bits) for t in self.tokens])
        held = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.surplus = np.array([len(t) for t in self.tokens]) - held
        cut = np.arange(0, len(self.node), fanout)
        self.cut = np.append(cut, len(self.node))
        self.inner_bits = np.bitwise_or.reduceat(self.bits, cut, axis=0)
        self.inner_surplus = np.maximum.reduceat(self.surplus, cut)
        self.least = np.minimum.reduceat(self.size, cut)
        self.most = np.maximum.reduceat(self.size, cut)


class Sets:
    """Union-find over the members in a task."""

    def __init__(self, nodes: np.ndarray):
        self.parent = {int(n): int(n) for n in nodes}

    def find(self, a: int) -> int:
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def traverse(left: Tree, right: Tree, sets: Sets, percent: int) -> list[tuple[int, int]]:
    """Spanning links found by dual traversal of two trees (or of one with itself)."""
    links = []
    same = left is right
    for i in range(len(left.cut) - 1):
        fit = (100 * left.most[i] >= percent * right.least) & (100 * right.most >= percent * left.least[i])
        if same:
            fit[:i] = False
        bound = common_bits(left.inner_bits[i], right.inner_bits) + np.minimum(left.inner_surplus[i], right.inner_surplus)
        fit &= bound >= needed(left.least[i], right.least, percent)
        for j in np.flatnonzero(fit):
            mine = range(left.cut[i], left.cut[i + 1])
            theirs = np.arange(right.cut[j], right.cut[j + 1])
            marks = {sets.find(int(left.node[a])) for a in mine} | {sets.find(int(n)) for n in right.node[theirs]}
            if len(marks) == 1:
                continue
            for a in mine:
                other = theirs[theirs > a] if same else theirs
                least = needed(left.size[a], right.size[other], percent)
                reach = common_bits(left.bits[a], right.bits[other]) + np.minimum(left.surplus[a], right.surplus[other])
                for b in other[reach >= least]:
                    x, y = int(left.node[a]), int(right.node[b])
                    if sets.find(x) == sets.find(y):
                        continue
                    both = len(np.intersect1d(left.tokens[a], right.tokens[b], assume_unique=True))
                    if 100 * both >= percent * (left.size[a] + right.size[b] - both) and sets.join(x, y):
                        links.append((x, y))
    return links


def join_pairs(percent: int, fanout: int):
    """Per pair of roots: the dual traversal of their trees."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(frames, "pair"):
            bits = 1 << int(max(9, np.ceil(np.log2(8 * group["n_shingles"].max()))))
            sides = [side for _, side in group.groupby("root", sort=True)]
            trees = [Tree(side, bits, fanout) for side in sides]
            sets = Sets(group["node"].to_numpy())
            links = traverse(trees[0], trees[-1], sets, percent)
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return run


def jaccard_components(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 75,
    node_members: int = 256,
    fanout: int = 16,
    bucket_tokens: int = 2_000_000,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("doc_id"), F.col(key).isNotNull().alias("present"), F.col(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A shingle starts at each word: the characters bound the tokens, which sizes the buckets.
    letters = docs.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = max(parts, int(letters / 6 / bucket_tokens) + 1)

    posted = "bucket long, chunk long, tokens binary, ids array<long>, present array<boolean>, sizes array<long>, prints array<binary>"
    posts = rows.mapInPandas(post(width, buckets), posted)
    answers = posts.repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk").mapInPandas(answer, posted + ", classes binary")
    whole = answers.repartition(parts, "chunk").sortWithinPartitions("chunk")
    known = State(whole.mapInPandas(gather(percent), "doc_id long, n_shingles long, print binary, tokens binary"), "shingles")

    may = known.df.filter("tokens IS NOT NULL")
    # Equal sets become one member, numbered as the table is written: ids may be any number, repeat or be missing.
    member = may.groupBy("print").agg(
        F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens")
    )
    node = F.monotonically_increasing_id().alias("node")
    members = State(member.select(node, "least_id", "print", "n_shingles", "tokens"), "members")
    routed = members.df.select("node", "n_shingles", "tokens").mapInPandas(prefixes(percent), "token long, node long")
    hubs = routed.groupBy("token").agg(F.min("node").alias("b"), F.max("node").alias("top")).filter("b < top")
    forests = components(routed.join(hubs.select("token", "b"), "token").select(F.col("node").alias("a"), "b").distinct())
    forests = State(forests, "forests")

    # Roots: members of one forest and size class (a factor of 4/3, so links join equal or neighbouring classes).
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0 / percent)))
    placed = members.df.join(forests.df.withColumnRenamed("root", "forest"), "node").select(
        "node", "forest", "n_shingles", "tokens", level.alias("class")
    )
    counts = placed.groupBy("forest", "class").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("n", F.ceil(F.col("n") / F.lit(node_members)))
    # Small forests are one root whatever their sizes; the range is in the root.
    forest = Window.partitionBy("forest")
    narrow = F.max("class").over(forest) - F.min("class").over(forest) <= 2
    counts = counts.withColumn("small", narrow & (F.max("n").over(forest) == 1))
    placed = placed.join(counts, ["forest", "class"])
    slot = F.when(F.col("small"), F.xxhash64("forest")).otherwise(
        F.xxhash64("forest", "class", F.pmod(F.xxhash64("node", F.lit(1)), F.col("n")))
    )
    placed = State(placed.select("node", "forest", "n_shingles", "tokens", "class", "small", slot.alias("root")), "placed")

    single = placed.df.filter("small").select(F.col("root").alias("root_a"), F.col("root").alias("root_b")).distinct()
    large = placed.df.filter("NOT small").repartition("root").sortWithinPartitions("root")
    shape = "forest long, root long, class long, least long, most long, surplus long, bits binary"
    tops = State(large.mapInPandas(roots, shape), "roots")
    side = lambda mark: [F.col(c).alias(f"{c}_{mark}") for c in ("root", "least", "most", "surplus", "bits")]
    near = tops.df.select("forest", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"), F.col("class").alias("own"), *side("b"))
    pairs = tops.df.select("forest", "class", *side("a")).join(near, ["forest", "class"])
    pairs = pairs.filter("own < class OR root_a <= root_b").drop("forest", "class", "own")
    allowed = single.union(pairs.mapInPandas(possible(percent), "root_a long, root_b long"))
    allowed = allowed.select(F.xxhash64("root_a", "root_b").alias("pair"), F.explode(F.array_distinct(F.array("root_a", "root_b"))).alias("root"))
    tasks = placed.df.select("node", "n_shingles", "tokens", "root").join(allowed, "root")
    links = tasks.repartition(parts, "pair").sortWithinPartitions("pair", "root").mapInPandas(join_pairs(percent, fanout), "a long, b long")
    linked = components(links)

    classes = members.df.select("print", "node", "least_id").join(linked, "node", "left")
    classes = State(classes.select("print", "least_id", F.coalesce("root", "node").alias("root")), "classes")
    # One row per component; a component without any id has none.
    lowest = classes.df.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = classes.df.select("print", "root").join(lowest, "root").select("print", "component_id")
    labelled = known.df.select("doc_id", "n_shingles", "print").join(named, "print", "left")
    result = State(labelled.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "components")
    for state in (known, members, forests, placed, tops, classes):
        state.drop()
    return result.df


@query("op1_ngram_jaccard_join")
def join_query(spark, folder):
    return jaccard_components(table(spark, folder, "documents"))
