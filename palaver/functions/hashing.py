"""Stable hashes: salted buckets, threshold assignment and pseudo-random order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bucket(seed: str, key: Column) -> Column:
    """Position of seed:key in [0, 1): the first 64 bits of its SHA-256."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), key), 256)
    number = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return number / F.lit(18446744073709551616.0)


def assign(position: Column, ratios=(0.8, 0.1, 0.1)) -> Column:
    """train, validation or test by the cumulated ratios."""
    return F.when(position < ratios[0], "train").when(position < ratios[0] + ratios[1], "validation").otherwise("test")


def shuffled(seed: str, key: Column) -> Column:
    """Sort key of a stable pseudo-random order."""
    return F.sha1(F.concat(F.lit(seed + ":"), key))


def joined_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)
