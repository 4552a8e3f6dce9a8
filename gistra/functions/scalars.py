"""Bit functions, means, modular arithmetic and further hashes as columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

U = np.uint64
#: The two published multipliers of the 64-bit finaliser, and the increment and multipliers of the stateless mixer.
FINAL = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
STEP, MIXERS = 0x60BEE2BEE120FC15, (0xA3B195354A39B70D, 0x1B03738712FAD5C9)
#: Multiplier and increment of the congruential generator.
CONGRUENCE = (6364136223846793005, 1442695040888963407)
PRIME = (1 << 61) - 1


def arrow64(f):
    """A column function over BIGINT from a numpy function over uint64."""

    def of(c: Column) -> Column:
        @F.pandas_udf("bigint")
        def applied(s: pd.Series) -> pd.Series:
            return pd.Series(f(s.to_numpy().view(U)).view(np.int64))

        return applied(c)

    return of


def finaliser(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(FINAL[0])
    x = x ^ (x >> U(33))
    x = x * U(FINAL[1])
    return x ^ (x >> U(33))


def finaliser_inverse(y: np.ndarray) -> np.ndarray:
    back = lambda v: v ^ (v >> U(33))  # noqa: E731  (a shift by more than half its width undoes itself)
    for c in reversed(FINAL):
        y = back(y) * U(pow(c, -1, 1 << 64))
    return back(y)


def _folded(x: np.ndarray, by: int) -> np.ndarray:
    """High and low half of the 128-bit product, xored."""
    a, b, c, d = x >> U(32), x & U(0xFFFFFFFF), U(by >> 32), U(by & 0xFFFFFFFF)
    low = b * d
    mid1, mid2 = a * d, b * c
    carry = (low >> U(32)) + (mid1 & U(0xFFFFFFFF)) + (mid2 & U(0xFFFFFFFF))
    high = a * c + (mid1 >> U(32)) + (mid2 >> U(32)) + (carry >> U(32))
    return high ^ (x * U(by))


def stateless(x: np.ndarray) -> np.ndarray:
    """A step of the generator that adds and folds two products."""
    return _folded(_folded(x + U(STEP), MIXERS[0]), MIXERS[1])


def stream(seed: int, index: np.ndarray) -> np.ndarray:
    """The numbers that the generator started at ``seed`` gives at these places (from 0): its state only counts up."""
    return stateless(U(seed) + index * U(STEP))


def permuted_congruence(x: np.ndarray) -> np.ndarray:
    """32 bits of a congruential step of x, shifted and rotated by its top bits."""
    s = x * U(CONGRUENCE[0]) + U(CONGRUENCE[1])
    v = (((s >> U(18)) ^ s) >> U(27)) & U(0xFFFFFFFF)
    turn = s >> U(59)
    return ((v >> turn) | (v << ((U(32) - turn) & U(31)))) & U(0xFFFFFFFF)


def wang32(x: np.ndarray) -> np.ndarray:
    """The 32-bit shift-and-add mix, on the lower half."""
    v = x.astype(np.uint32)
    s = np.uint32
    v = ~v + (v << s(15))
    v ^= v >> s(12)
    v = v + (v << s(2))
    v ^= v >> s(4)
    v = v * s(2057)
    return (v ^ (v >> s(16))).astype(U)


def inverse64(x: np.ndarray) -> np.ndarray:
    """The odd number that x is multiplied by to give 1 modulo 2^64, doubling the right bits at each step."""
    y = x * U(3) ^ U(2)
    for _ in range(4):
        y = y * (U(2) - x * y)
    return y


def reversible(x: np.ndarray, steps: list[tuple[str, int]]) -> np.ndarray:
    """Steps (xor, add, mul, rotl) applied in order; ``reversed_steps`` undo them."""
    for kind, c in steps:
        x = {"xor": lambda v: v ^ U(c), "add": lambda v: v + U(c), "mul": lambda v: v * U(c), "rotl": lambda v: (v << U(c)) | (v >> U(64 - c))}[kind](x)
    return x


def reversed_steps(steps: list[tuple[str, int]]) -> list[tuple[str, int]]:
    undo = {"xor": lambda c: c, "add": lambda c: -c % (1 << 64), "mul": lambda c: pow(c, -1, 1 << 64), "rotl": lambda c: 64 - c}
    return [(kind, undo[kind](c)) for kind, c in reversed(steps)]


def polynomial(c: Column, coefficients: list[int]) -> Column:
    """A k-wise independent hash: the polynomial of whole numbers modulo 2^61 - 1, exact in DECIMAL(38)."""
    d = lambda v: v.cast("decimal(19,0)")
    out = F.lit(coefficients[0]).cast("decimal(19,0)")
    for k in coefficients[1:]:
        out = d((out * d(c) + F.lit(k).cast("decimal(19,0)")) % F.lit(PRIME).cast("decimal(19,0)"))
    return out.cast("bigint")


def bit_facts(c: Column) -> dict[str, Column]:
    """Of a positive whole number: leading and trailing zeros, first set bit, set bits, whole log2, next power of two, whether it is one, and the mask that covers it."""
    digits = F.length(F.bin(c))
    trailing = digits - F.length(F.rtrim(F.bin(c), F.lit("0")))
    top = F.call_function("shiftleft", F.lit(1).cast("bigint"), digits.cast("int"))
    power = F.bit_count(c) == 1
    return {"clz": 64 - digits, "ctz": trailing, "ffs": trailing + 1, "popcount": F.bit_count(c), "ilog2": digits - 1, "roundup": F.when(power, c).otherwise(top), "is_pow2": power, "bitmask": top - 1}


def approximate_ln(c: Column) -> Column:
    """Logarithm from the binary exponent and a parabola through the mantissa, within 0.01."""
    e = F.floor(F.log2(c))
    m = c / F.pow(F.lit(2.0), e) - 1
    return (e + m * (1.3465557 - 0.34655572 * m)) * math.log(2)


def compensated_sum(values: Column) -> Column:
    """Sum of a short array with a running correction of rounding errors."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(acc, x):
        y = x - acc["c"]
        t = acc["s"] + y
        return F.struct(t.alias("s"), ((t - acc["s"]) - y).alias("c"))

    return F.aggregate(values, zero, step, lambda acc: acc["s"])
