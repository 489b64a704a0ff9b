"""Stable ids, buckets and orders from SHA-256, equal on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str | int, sep: str = ":") -> Column:
    """Hex SHA-256 of the parts joined by ``sep``; strings and numbers are literals, columns are columns. Null parts give null."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    joined: list[Column] = []
    for i, c in enumerate(cols):
        joined += [F.lit(sep)] * (i > 0) + [c.cast("string")]
    return F.sha2(F.concat(*joined), 256)


def head64(hexed: Column) -> Column:
    """The first 8 bytes of a hex digest as an unsigned number."""
    return F.conv(F.substring(hexed, 1, 16), 16, 10).cast("decimal(20,0)")


def stable_number(*parts: Column | str | int, seed: int = 42) -> Column:
    """Unsigned 64-bit number of ``seed:parts``."""
    return head64(digest(seed, *parts))


def stable_number_tail(*parts: Column | str | int, seed: int = 42) -> Column:
    """Unsigned 64-bit number of the parts and the seed joined by the unit separator, seed last."""
    return head64(digest(*parts, seed, sep="\x1f"))


def stable_id(prefix: str, *parts: Column | str | int, seed: int = 42) -> Column:
    """``prefix_`` and 16 hex digits."""
    return F.concat(F.lit(prefix + "_"), F.substring(digest(seed, *parts), 1, 16))


def content_id(prefix: str, canonical: Column) -> Column:
    """``prefix_`` and 16 hex digits of a canonical text alone."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(canonical, 256), 1, 16))


def bucket(id_col: Column, seed: int = 42, n: int = 100) -> Column:
    """Bucket 0 to n - 1 of an id."""
    return (stable_number(id_col, seed=seed) % F.lit(n).cast("decimal(20,0)")).cast("int")


def assign_split(bucket_col: Column, train: int = 85, validation: int = 10) -> Column:
    """train, validation or test by bucket of 100."""
    return F.when(bucket_col < train, "train").when(bucket_col < train + validation, "validation").otherwise("test")


def order_key(id_col: Column, seed: int = 42) -> Column:
    """Hex key by which rows get a deterministic order."""
    return digest(seed, id_col)


def first_position(*parts: Column | str | int, seed: int = 42) -> Column:
    """Whether the first of two candidates is shown as A: parity of the stable number."""
    return (stable_number(*parts, seed=seed) % 2) == 0
