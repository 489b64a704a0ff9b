"""Canonical form, content keys and rolling window hashes of texts."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DROP = re.compile("[^0-9a-zA-Z一-鿿]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def canonical(text: str | None) -> str:
    """NFKC, lower case, then only 0-9, a-z, A-Z and U+4E00 to U+9FFF."""
    return _DROP.sub("", unicodedata.normalize("NFKC", text).lower()) if text else ""


def content_key(text: str) -> bytes:
    """128 bits that name a text."""
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def windows(code: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all windows of ``width`` code points, in text order."""
    n = len(code) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            h = h * BASE + code[k : k + n] + np.uint64(1)
        return mix(h)


#: Bits of a hash in ``distinct_windows``, and the most texts and characters it takes at once.
HASH_BITS = 52
TEXTS, CHARACTERS = 1 << (64 - HASH_BITS), 1 << 20


def runs(texts: list[str]) -> Iterator[slice]:
    """Runs of at most TEXTS texts and some CHARACTERS characters, single texts at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHARACTERS or i + 1 - start == TEXTS or i + 1 == len(texts):
            yield slice(start, i + 1)
            start, size = i + 1, 0


def distinct_windows(texts: list[str], width: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Sorted ``number of the text << HASH_BITS | hash`` of the distinct windows of each of at most TEXTS texts, or of those in a table of bits."""
    code = codes("".join(texts))
    length = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.cumsum(length) - length
    text = np.repeat(np.arange(len(texts)), length)
    at = np.flatnonzero(np.arange(len(code)) - start[text] <= length[text] - width)
    h = windows(code, width)[at] >> np.uint64(64 - HASH_BITS)
    if wanted is not None:
        hit = in_table(wanted, h)
        at, h = at[hit], h[hit]
    both = np.sort(text[at].astype(np.uint64) << np.uint64(HASH_BITS) | h)
    return both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both  # np.unique hashes, which takes some 30 times as long


def split_windows(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of ``distinct_windows``."""
    return (both >> np.uint64(HASH_BITS)).astype(np.int64), both & np.uint64((1 << HASH_BITS) - 1)


def pieces(text: str, width: int) -> set[str]:
    """Distinct pieces of ``width`` characters."""
    return {text[i : i + width] for i in range(len(text) - width + 1)}


#: Places in a table that tells which hashes are looked for: SPARSE for each hash, between these bounds. A full table lets more
#: through to the exact join behind it and changes no result.
SPARSE, FEWEST, MOST = 16, 1 << 16, 1 << 31


def bit_table(df: DataFrame, column: str, n: int) -> np.ndarray:
    """Which places the hashes in ``column`` take in a table of bits sized for ``n`` different ones. At most ``MOST`` / 8 bytes reach the driver."""
    size = min(MOST, max(FEWEST, 1 << max(SPARSE * n - 1, 1).bit_length()))
    place = F.pmod(F.col(column), F.lit(size))
    rows = df.select(place.alias("p")).groupBy(F.shiftright("p", 3).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1, cast(p % 8 as int)))").alias("byte")).toArrow()
    out = np.zeros(size // 8, dtype=np.uint8)
    out[rows["at"].to_numpy()] = rows["byte"].to_numpy()
    return out


def bits_of(h: np.ndarray) -> np.ndarray:
    """``bit_table`` of hashes that are at hand."""
    size = min(MOST, max(FEWEST, 1 << max(SPARSE * len(h) - 1, 1).bit_length()))
    out = np.zeros(size, dtype=np.uint8)
    out[(h & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little")


def in_table(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have their place taken."""
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def with_canonical(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns, ``canon`` and its 128-bit key ``ckey``; rows whose canonical form is empty are left out."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = [canonical(x) for x in b["_text"]]
            out = b[keep].assign(canon=c, ckey=[content_key(x) for x in c])
            yield out[[bool(x) for x in c]]

    return df.select(*keep, F.col(text).alias("_text")).where("_text is not null").mapInPandas(run, f"{kinds}, canon string, ckey binary")
