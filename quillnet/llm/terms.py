"""Terms of whole texts and small integer arrays as bytes, for the lexical index and the suffix arrays.

A term is a maximal run of characters outside ASCII or of ASCII letters and digits; only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Java and DuckDB spelling of a term, before and after A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWERED_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Every byte that is not part of a term becomes a space.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(
    bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
)
# Bytes of one text that are split at once.
SLICE = 4 << 20


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, in lists of bounded size."""
    body = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
    at = 0
    while at < len(body):
        end = body.find(b" ", at + SLICE) if at + SLICE < len(body) else -1
        end = end if end >= 0 else len(body)
        yield body[at:end].split()
        at = end


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers in as few whole bytes each as the largest needs; the first byte says how many."""
    top = int(values.max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    cells = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + cells.tobytes()


def unpacked(body: bytes) -> np.ndarray:
    width = body[0]
    count = (len(body) - 1) // width
    cells = np.zeros((count, 8), np.uint8)
    cells[:, :width] = np.frombuffer(body, np.uint8, count * width, 1).reshape(-1, width)
    return cells.view("<i8").ravel()
