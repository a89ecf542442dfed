"""Hash ranks, ids and addressable random draws. Everything is a function of its inputs, so retries give the same rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Increment and multipliers of the SplitMix64 generator (Steele, Lea and Flood, 2014).
SPLITMIX_GAMMA = 0x9E3779B97F4A7C15
SPLITMIX_MUL_1 = 0xBF58476D1CE4E5B9
SPLITMIX_MUL_2 = 0x94D049BB133111EB


def hash_rank(key: Column, seed: int) -> Column:
    """Hex SHA-256 of ``seed:key``; ordering by it is a reproducible shuffle."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def pair_id(field: Column, golden: Column, predicted: Column) -> Column:
    digest = F.sha2(F.concat(field, F.lit("\n"), golden, F.lit("\n"), predicted), 256)
    return F.concat(F.lit("p-"), F.substring(digest, 1, 12))


def item_id(doc_id: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(doc_id.cast("string"), 256), 1, 24))


def _digest(seed: int, key: Column, counter: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"), counter.cast("string")), 256)


def _number(digest: Column) -> Column:
    """The first eight bytes of a digest, little endian."""
    return F.conv(F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in range(7, -1, -1)]), 16, 10).cast("decimal(20,0)")


def drawn(number: Column, n: Column) -> Column:
    """The draw in [0, n) that a number of :func:`hash_numbers` stands for."""
    return (number % n.cast("decimal(20,0)")).cast("long")


def hash_draw(seed: int, key: Column, counter: Column | int, n: Column | int) -> Column:
    """Uniform draw in [0, n): the first eight bytes of SHA-256(``seed:key:counter``), little endian, modulo n."""
    counter = F.lit(counter) if isinstance(counter, int) else counter
    n = F.lit(n) if isinstance(n, int) else n
    return drawn(_number(_digest(seed, key, counter)), n)


def hash_numbers(seed: int, key: Column, counters: Column) -> Column:
    """What :func:`hash_draw` draws from, for an array of counters: each digest is made once, also where nothing is compiled."""
    return F.transform(F.transform(counters, lambda c: _digest(seed, key, c)), _number)


def splitmix(seed: int, k: np.ndarray, n: int) -> np.ndarray:
    """The k-th draws (1-based) in [0, n) of the stream started at ``seed``, by multiply-high."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + k.astype(np.uint64) * np.uint64(SPLITMIX_GAMMA)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(SPLITMIX_MUL_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SPLITMIX_MUL_2)
        z ^= z >> np.uint64(31)
        low = (z & np.uint64(0xFFFFFFFF)) * np.uint64(n)
        high = (z >> np.uint64(32)) * np.uint64(n) + (low >> np.uint64(32))
    return (high >> np.uint64(32)).astype(np.int64)


def splitmix_pieces(seed: int, n: int, first: int, count: int, piece: int = 1 << 15):
    """Draws ``first`` + 1 to ``first`` + ``count`` of :func:`splitmix`, in pieces that stay in the caches. The buffer is reused."""
    size, gamma, low32 = min(piece, count), SPLITMIX_GAMMA, np.uint64(0xFFFFFFFF)
    steps = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(gamma)
    drawn, spare = np.empty_like(steps), np.empty_like(steps)
    half, n = np.uint64(32), np.uint64(n)
    for at in range(0, count, size):
        z, t = drawn[:min(size, count - at)], spare[:min(size, count - at)]
        np.add(steps[:len(z)], np.uint64((seed + (first + at) * gamma) % (1 << 64)), out=z)
        for shift, factor in ((30, SPLITMIX_MUL_1), (27, SPLITMIX_MUL_2), (31, 1)):
            np.bitwise_xor(z, np.right_shift(z, np.uint64(shift), out=t), out=z)
            if factor > 1:
                np.multiply(z, np.uint64(factor), out=z)
        np.right_shift(np.multiply(np.bitwise_and(z, low32, out=t), n, out=t), half, out=t)
        np.multiply(np.right_shift(z, half, out=z), n, out=z)
        yield np.right_shift(np.add(z, t, out=z), half, out=z).view(np.int64)


def splitmix_draw(seed: int, k: Column, n: int) -> Column:
    """:func:`splitmix` over a column of counters."""

    @F.pandas_udf("long")
    def draw(counters: pd.Series) -> pd.Series:
        return pd.Series(splitmix(seed, counters.to_numpy(), n))

    return draw(k)
