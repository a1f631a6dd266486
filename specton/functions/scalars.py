"""Scalar functions: rounding rules, colour, hashes and the seeded generator, as columns; and numpy twins for drivers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 0xFFFFFFFF


def round_half_up(x: Column) -> Column:
    """Halves go up, also for negative numbers."""
    return F.floor(x + 0.5)


def round_clamped(x: Column) -> Column:
    """Halves go to the even neighbour, then into 0 to 255: how an 8-bit sample is stored."""
    return F.least(F.greatest(F.bround(x), F.lit(0.0)), F.lit(255.0)).cast("int")


def clamp_setting(text: Column, low: int, high: int, fallback: int) -> Column:
    """An integer setting from text: unreadable gives the fallback, anything else is moved into the range."""
    x = text.try_cast("int")
    return F.when(x.isNull(), F.lit(fallback)).otherwise(F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def srgb_to_linear(c: Column) -> Column:
    """One 8-bit channel to linear light."""
    x = c / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* under D65 of 8-bit sRGB channels."""
    lr, lg, lb = srgb_to_linear(r), srgb_to_linear(g), srgb_to_linear(b)
    x = (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047
    y = 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb
    z = (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883
    f = lambda t: F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116)
    return 116 * f(y) - 16, 500 * (f(x) - f(y)), 200 * (f(y) - f(z))


def multiplicative_hash(i: Column, factor: int, buckets: int) -> Column:
    """(i * factor mod 2**32) mod buckets, without leaving 64 bits."""
    low, high = i.bitwiseAND(F.lit(0xFFFF)), F.shiftright(i, 16).bitwiseAND(F.lit(0xFFFF))
    product = (low * factor + F.shiftleft((high * (factor & 0xFFFF)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(WORD))
    return product % buckets


def product32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two numbers of 32 bits, without leaving 64 bits."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(a, 16)
    upper = F.shiftleft((high * b.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low * b + upper).bitwiseAND(F.lit(WORD))


def mulberry32_at(seed: Column, n: Column) -> Column:
    """The generator's n-th number (from 0) for a seed, as columns: any draw without those before it."""
    own = (seed.cast("long") + (n.cast("long") + 1) * 0x6D2B79F5).bitwiseAND(F.lit(WORD))
    t = product32(own.bitwiseXOR(F.shiftrightunsigned(own, 15)), own.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + product32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(WORD)))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / 4294967296.0


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    h = 2166136261
    raw = text.encode("utf-16-le", "surrogatepass")
    for k in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[k : k + 2], "little")) * 16777619 & WORD
    return h


def mulberry32(seed: int) -> Iterator[float]:
    """The public-domain 32-bit generator of that name: numbers from 0 to 1."""
    state = seed & WORD
    while True:
        state = (state + 0x6D2B79F5) & WORD
        t = (state ^ state >> 15) * (state | 1) & WORD
        t ^= (t + ((t ^ t >> 7) * (t | 61) & WORD)) & WORD
        yield (t ^ t >> 14) / 4294967296


def shuffled(items: list, draws: Iterator[float]) -> list:
    """Fisher-Yates from the end, with the generator's next numbers."""
    out = list(items)
    for i in range(len(out) - 1, 0, -1):
        j = int(next(draws) * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out
