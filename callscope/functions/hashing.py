"""Random numbers derived from keys.

A draw depends only on (key, stream, seed). It is the same after a retry, in another partition
layout and for every tool that scores the key, which is what paired resampling needs; ``rand``
gives none of that. The key is digested once per row with md5; each further draw costs a dozen
integer operations inside generated code.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Modulus of the draws, odd multipliers of the mixer.
DRAW_RANGE = 1 << 31
MASK = DRAW_RANGE - 1
MULTIPLIERS = (73244475, 94906249)
STREAM_STEP = 40503
SECOND_DRAW = 20011
# Distribution function of Poisson(1), as far as a draw resolves it: the last bound below DRAW_RANGE
# leaves one draw in 2^31 for all larger counts together.
POISSON_ONE_CDF = tuple(
    bound
    for bound in accumulate(math.exp(-1) / math.factorial(k) for k in range(16))
    if int(bound * DRAW_RANGE) < DRAW_RANGE
)[:13]


def with_digest(frame: DataFrame, key: str = "key", names: tuple[str, str] = ("_h", "_l")) -> DataFrame:
    """Add two 28-bit halves of the md5 of a key. Do this *before* exploding replicates."""
    text = F.md5(F.col(key).cast("string"))
    return frame.withColumns(
        {
            names[0]: F.conv(F.substring(text, 1, 7), 16, 10).cast("bigint"),
            names[1]: F.conv(F.substring(text, 8, 7), 16, 10).cast("bigint"),
        }
    )


def _rounds(frame: DataFrame, name: str, stream: Column | int, seed: int, names: tuple[str, str]) -> DataFrame:
    """One projection per round: a round uses its input twice, nested it would double every time."""
    high, low = names
    step = stream.cast("bigint") if isinstance(stream, Column) else F.lit(int(stream)).cast("bigint")
    start = (step * F.lit(STREAM_STEP) + F.lit(int(seed))).bitwiseAND(F.lit(MASK))
    x = F.col(name)
    frame = frame.withColumn(name, F.col(high).bitwiseXOR(start))
    for half in (low, None):
        for multiplier in MULTIPLIERS:
            frame = frame.withColumn(
                name, (x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(multiplier)).bitwiseAND(F.lit(MASK))
            )
        folded = x.bitwiseXOR(F.shiftright(x, 13))
        frame = frame.withColumn(name, folded if half is None else folded.bitwiseXOR(F.col(half)))
    return frame


def _settled(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column the optimizer does not look through.

    A filter or join on the value would otherwise be pushed below the rounds with all of them
    written out inside the condition, which grows beyond what code generation can compile.
    """
    return frame.select("*", F.explode(F.array(value)).alias(name))


def with_draw(
    frame: DataFrame, name: str, stream: Column | int, seed: int, names: tuple[str, str] = ("_h", "_l")
) -> DataFrame:
    """Add a uniform integer in [0, 2^31) for one stream (replicate) of the digested key."""
    return _settled(_rounds(frame, "_x", stream, seed, names), name, F.col("_x")).drop("_x")


def with_poisson(
    frame: DataFrame, name: str, stream: Column, seed: int, names: tuple[str, str] = ("_h", "_l")
) -> DataFrame:
    """Add a Poisson(1) weight per stream; negative streams stand for the data itself, weight 1."""
    weight = F.when(stream < 0, F.lit(1).cast("bigint")).otherwise(poisson_one(F.col("_x")))
    return _settled(_rounds(frame, "_x", stream, seed, names), name, weight).drop("_x")


def unit(drawn: Column | str) -> Column:
    """A draw as a double in [0, 1)."""
    return (F.col(drawn) if isinstance(drawn, str) else drawn) / F.lit(float(DRAW_RANGE))


def poisson_one(drawn: Column) -> Column:
    """Poisson(1) count behind a draw, by inverse distribution function."""
    result = F.lit(len(POISSON_ONE_CDF))
    for count in reversed(range(len(POISSON_ONE_CDF))):
        bound = int(POISSON_ONE_CDF[count] * DRAW_RANGE)
        result = F.when(drawn < F.lit(bound), F.lit(count)).otherwise(result)
    return result.cast("bigint")


def poisson_bounds(mean: float) -> tuple[int, ...]:
    """Draws below the k-th bound stand for a count of at most k; all above the last for one more."""
    share = accumulate(math.exp(-mean) * mean**k / math.factorial(k) for k in range(16))
    return tuple(x for x in (int(bound * DRAW_RANGE) for bound in share) if x < DRAW_RANGE)[:13]


def draw_block(high: np.ndarray, low: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """The draws of ``with_draw`` for whole blocks: a row per digest, columns for streams 0 .. reps-1."""
    # Only the lowest 31 bits of a product are kept, so numbers of 32 bits that wrap around will do.
    step = ((np.arange(reps, dtype=np.int64) * STREAM_STEP + seed) & MASK).astype(np.uint32)
    x = high.astype(np.uint32)[:, None] ^ step[None, :]
    half_low, moved = low.astype(np.uint32)[:, None], np.empty_like(x)
    for half in (half_low, None):
        for multiplier in MULTIPLIERS:
            np.right_shift(x, np.uint32(15), out=moved)
            x ^= moved
            x *= np.uint32(multiplier)
            x &= np.uint32(MASK)
        np.right_shift(x, np.uint32(13), out=moved)
        x ^= moved
        if half is not None:
            x ^= half
    return x.view(np.int32)


def poisson_weights(
    high: np.ndarray, low: np.ndarray, reps: int, seed: int, bounds: tuple[int, ...] = poisson_bounds(1.0)
) -> np.ndarray:
    """The weights of ``with_poisson`` for whole blocks: one row per digest, columns for the data
    itself (weight 1) and for replicates 0 .. reps-1, as small whole numbers."""
    x = draw_block(high, low, reps, seed)
    weights = np.zeros((len(high), reps + 1), np.uint8)
    weights[:, 0] = 1
    for bound in bounds:
        above = x >= np.int32(bound)
        if not above.any():
            break
        weights[:, 1:] += above
    return weights


def with_index(
    frame: DataFrame, name: str, stream: Column | int, seed: int, size: Column, names: tuple[str, str] = ("_h", "_l")
) -> DataFrame:
    """Add a uniform index in 0 .. size-1 from 62 random bits; NULL where ``size`` is 0."""
    first = _rounds(frame, "_x", stream, seed, names)
    both = _rounds(first, "_y", stream, seed + SECOND_DRAW, names)
    wide = F.col("_x") * F.lit(DRAW_RANGE) + F.col("_y")
    return _settled(both, name, F.when(size > 0, wide % size)).drop("_x", "_y")
