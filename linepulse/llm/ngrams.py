"""Hashed character n-grams of whole texts, by numpy, for the learned operators."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = 32


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Is a code point a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text between two spaces; what is no letter becomes a space."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(letters()[c], c, np.uint32(SPACE))


def hashed(c: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Hashes (``bits`` bits) of all n-grams of the given sizes."""
    out, h = [], np.zeros(len(c), dtype=np.uint32)
    for n in range(1, max(sizes) + 1):
        if len(c) < n:
            break
        h = (h[:-1] if n > 1 else h) * np.uint32(0x01000193) + c[n - 1:]
        if n in sizes:
            x = (h ^ (h >> np.uint32(15)) ^ np.uint32(n)) * np.uint32(0x9E3779B1)
            out.append(x >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def bounded_sample(rows: DataFrame, key: str, group: str, most: int, salt: str) -> tuple[DataFrame, dict]:
    """At most ``most`` rows of each group, drawn by a digest of the key; also the size of each group.

    A threshold on the digest draws them where they are, so only the drawn rows move.  Groups are few (classes or
    languages); their sizes are collected.
    """
    sizes = {r[group]: r["n"] for r in rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).limit(10_001).collect()}
    if len(sizes) > 10_000:
        raise ValueError(f"more than 10000 values of {group}")
    drawn = None
    share = F.lit(0.0)
    for g, n in sizes.items():
        share = F.when(F.col(group) == F.lit(g), F.lit(min(1.0, 0.95 * most / n if n > most else 1.0))).otherwise(share)
    spread = (F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    drawn = rows.where(spread < share)
    return drawn, sizes
