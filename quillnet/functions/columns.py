"""Column builders shared by the operators."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

ANONYMOUS_PREFIX = "ip:"


def rounded(column: Column, digits: int = 6) -> Column:
    return F.round(column, digits)


def is_anonymous(user_id: Column) -> Column:
    return user_id.startswith(ANONYMOUS_PREFIX)


def is_bot(username: Column) -> Column:
    return F.lower(username).contains("bot")


def numeric_id(user_id: Column) -> Column:
    """Integer id of a registered user, null for anonymous ones (a plain cast raises under ANSI)."""
    return user_id.try_cast("bigint")


def log_words(words: Column) -> Column:
    return F.log(words + F.lit(1))


def period_label(year: Column, quarter: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), quarter.cast("string"))


def quarter_start(timestamp: Column) -> Column:
    return F.date_trunc("quarter", timestamp)


def pack_node_id(node: Column, year: Column, quarter: Column) -> Column:
    """Quarter digit, last digit of the year and the id, read as one number."""
    return F.concat(
        quarter.cast("string"), F.pmod(year, F.lit(10)).cast("string"), node.cast("string")
    ).cast("bigint")


def unpack_node_id(packed: Column, decade: int = 2000) -> dict[str, Column]:
    """Inverse of :func:`pack_node_id`; years are taken from the ten years starting at ``decade``."""
    text = packed.cast("string")
    digit = F.substring(text, 2, 1).cast("int")
    first = decade % 10
    return {
        "quarter": F.substring(text, 1, 1).cast("int"),
        "year": F.lit(decade) + F.pmod(digit - F.lit(first), F.lit(10)),
        "node_id": F.substring(text, F.lit(3), F.length(text)).cast("bigint"),
    }


def uniform_hash(*parts: Column | str, seed: int) -> Column:
    """Reproducible uniform number in [0, 1): 32 bits of an md5 digest."""
    digest = F.md5(F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def keep_probability(size: Column, epsilon: float, method: str = "any") -> Column:
    """Probability of keeping an edge of a clique of ``size`` members.

    ``any``: a given member loses all its edges with probability at most epsilon.
    ``all``: some member loses all its edges with probability at most epsilon.
    """
    k = size.cast("double")
    if method == "any":
        return F.lit(1.0) - F.pow(F.lit(epsilon), F.lit(1.0) / (k - 1))
    if method == "all":
        alone = F.lit(1.0) - F.pow(F.lit(1.0 - epsilon), F.lit(1.0) / k)
        return F.lit(1.0) - F.pow(alone, F.lit(1.0) / (k - 1))
    raise ValueError(f"unknown method: {method}")


def pair_count(size: Column) -> Column:
    """Number of pairs among ``size`` members, as a whole number."""
    n = size.cast("bigint")
    return F.shiftright(n * (n - 1), 1)


def vector_sum(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + x)


def vector_scale(vector: Column, factor: Column) -> Column:
    return F.transform(vector, lambda x: x * factor)


def unit_sum(vector: Column) -> Column:
    """The vector divided by its sum; a zero vector stays zero."""
    total = vector_sum(vector)
    return F.transform(vector, lambda x: F.when(total != 0, x / total).otherwise(F.lit(0.0)))


def arg_max(vector: Column) -> Column:
    """Zero-based position of the first largest entry."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def cosine_similarity(left: Column, right: Column) -> Column:
    """Cosine of two vectors, zero when either has no length."""

    def dot(a: Column, b: Column) -> Column:
        return vector_sum(F.zip_with(a, b, lambda x, y: x * y))

    length = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when(length > 0, dot(left, right) / length).otherwise(F.lit(0.0))


def positions(vector: str, width: int) -> list[Column]:
    return [F.element_at(F.col(vector), i + 1) for i in range(width)]


def mean_vector(vector: str, width: int) -> Column:
    """Element-wise mean as one aggregate per position, so groups are combined before the shuffle."""
    return F.array(*[F.avg(c) for c in positions(vector, width)])


def sum_vector(vector: str, width: int) -> Column:
    return F.array(*[F.sum(c) for c in positions(vector, width)])
