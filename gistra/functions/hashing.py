"""Hashes as column expressions: 60 bits of md5, the same in any SQL engine, so registers can be compared exactly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 60
U = np.uint64


def h60(c: Column | str, seed: int | str = 0) -> Column:
    """60-bit non-negative hash; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string"))), 1, 15), 16, 10).cast("bigint")


def h60_seeded(c: Column, seed: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(seed.cast("string"), F.lit(":"), c.cast("string"))), 1, 15), 16, 10).cast("bigint")


def unit(h: Column) -> Column:
    """The hash as a number in (0, 1): its upper 52 bits, centred."""
    return (F.shiftright(h, 8).cast("double") + 0.5) / float(1 << 52)


def register(h: Column, p: int) -> Column:
    return F.shiftright(h, BITS - p).cast("int")


def remainder(h: Column, p: int) -> Column:
    return h.bitwiseAND((1 << (BITS - p)) - 1)


def rank(h: Column, p: int) -> Column:
    """Position of the first one bit after the register's bits."""
    r = remainder(h, p)
    return F.when(r == 0, BITS - p + 1).otherwise(BITS - p + 1 - F.length(F.bin(r))).cast("int")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), " "), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """Joined runs of n words; none if there are fewer. ``words`` is evaluated n times, not once for a run."""
    out = words
    for j in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(j + 1), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(out, lambda g: g.isNotNull())


#: Starts of substrings in a block: a character is found by walking from the block's begin, not the text's.
BLOCK = 64


def kmers(text: Column, k: int) -> Column:
    """All substrings of k characters. The text is cut in one sweep into blocks that reach k - 1 characters into the next."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{BLOCK + k - 1}}})).{{1,{BLOCK}}}"), F.lit(1))
    starts = lambda b: F.transform(F.sequence(F.lit(1), F.length(b) - k + 1), lambda i: F.substr(b, i, F.lit(k)))
    runs = F.transform(blocks, lambda b: F.when(F.length(b) >= k, starts(b)).otherwise(F.array().cast("array<string>")))
    return F.coalesce(F.flatten(runs), F.array().cast("array<string>"))


def wang64(x: np.ndarray) -> np.ndarray:
    """The 64-bit shift-and-add mix, vectorised; numpy integers wrap."""
    x = x.astype(U)
    x = ~x + (x << U(21))
    x ^= x >> U(24)
    x = x + (x << U(3)) + (x << U(8))
    x ^= x >> U(14)
    x = x + (x << U(2)) + (x << U(4))
    x ^= x >> U(28)
    return x + (x << U(31))


def _unshift(y: np.ndarray, by: int) -> np.ndarray:
    """The x of y = x ^ (x >> by)."""
    x = y.copy()
    for _ in range(64 // by + 1):
        x = y ^ (x >> U(by))
    return x


def wang64_inverse(y: np.ndarray) -> np.ndarray:
    inverse = lambda m: U(pow(m, -1, 1 << 64))
    x = y.astype(U) * inverse((1 << 31) + 1)
    x = _unshift(x, 28) * inverse(21)
    x = _unshift(x, 14) * inverse(265)
    x = _unshift(x, 24)
    return (x + U(1)) * inverse((1 << 21) - 1)


def wang_column(c: Column) -> Column:
    """The mix as an Arrow-batched column function over BIGINT."""
    @F.pandas_udf("bigint")
    def mixed(s: pd.Series) -> pd.Series:
        return pd.Series(wang64(s.to_numpy().view(U)).view(np.int64))

    return mixed(c)


def gamma2(h1: Column, h2: Column) -> Column:
    """A Gamma(2, 1) number from two hashes."""
    return -F.ln(unit(h1)) - F.ln(unit(h2))


_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
#: Longest message of one md5 block.
ONE_BLOCK = 55


def _md5_of_blocks(blocks: np.ndarray) -> np.ndarray:
    """First 60 bits of the md5 of messages of one padded block each: rows of 16 little-endian words."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    out, at_once = np.empty(len(blocks), np.int64), 32768
    for at in range(0, len(blocks), at_once):
        m = np.ascontiguousarray(blocks[at : at + at_once].T)
        a, b, c, d = (np.full(m.shape[1], x) for x in start)
        f, t = np.empty_like(a), np.empty_like(a)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
                g = i
            elif i < 32:
                np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
                g = (5 * i + 1) % 16
            elif i < 48:
                np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
                g = (3 * i + 5) % 16
            else:
                np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
                g = 7 * i % 16
            np.add(a, f, out=a), np.add(a, _SINES[i], out=a), np.add(a, m[g], out=a)
            by = _TURNS[i // 16][i % 4]
            np.left_shift(a, np.uint32(by), out=t), np.right_shift(a, np.uint32(32 - by), out=a), np.bitwise_or(a, t, out=a), np.add(a, b, out=a)
            a, b, c, d = d, a, b, c
        first, second = (a + start[0]).byteswap().astype(U), (b + start[1]).byteswap().astype(U)
        out[at : at + at_once] = ((first << U(28)) | (second >> U(4))).view(np.int64)
    return out


def h60_texts(texts: list[bytes], seeds: list[int] | None = None):
    """The hashes of ``h60`` for UTF-8 texts in Python, one array for each seed (default: seed 0 only)."""
    from hashlib import md5

    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    blocks, lead = None, 0
    for seed in seeds or [0]:
        prefix = b"%d:" % seed
        if len(prefix) != lead:  # blocks serve for all seeds of as many digits
            lead = len(prefix)
            short = np.flatnonzero(lens + lead <= ONE_BLOCK)
            long = np.flatnonzero(lens + lead > ONE_BLOCK)
            own = texts if not len(long) else [texts[i] for i in short.tolist()]
            blocks = np.zeros((len(short), 64), np.uint8)
            blocks[:, lead:56] = np.array(own, f"S{56 - lead}").view(np.uint8).reshape(len(short), 56 - lead)
            n = lens[short] + lead
            blocks[np.arange(len(short)), n] = 0x80
            blocks[:, 56:58] = (n * 8).astype("<u2").view(np.uint8).reshape(-1, 2)
        blocks[:, :lead] = np.frombuffer(prefix, np.uint8)
        h = np.empty(len(texts), np.int64)
        h[short] = _md5_of_blocks(blocks.view("<u4"))
        if len(long):
            h[long] = [int.from_bytes(md5(prefix + texts[i]).digest()[:8], "big") >> 4 for i in long.tolist()]
        yield h
