"""Seeded draws that other languages repeat bit by bit: a 32-bit generator and a shuffle, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the generator (Mulberry32).
STEP, MASK = 0x6D2B79F5, 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two numbers below 2^32; the parts stay within a long."""
    return (a.bitwiseAND(0xFFFF) * b + F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)


def draw(seed: Column, k: Column) -> Column:
    """The k-th draw (from 1) of a seed, from 0 to below 1. The generator's state is a counter, so any draw is had at once."""
    a = (seed.cast("long").bitwiseAND(MASK) + k.cast("long") * STEP).bitwiseAND(MASK)
    t = _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(1))
    return F.get(F.transform(F.array(t), _mixed), F.lit(0))


def _mixed(t: Column) -> Column:
    u = (t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(61))).bitwiseAND(MASK).bitwiseXOR(t)
    return u.bitwiseXOR(F.shiftright(u, 14)) / F.lit(4294967296.0)


def shuffled(items: Column, seed: Column) -> Column:
    """An array in the order of a Fisher-Yates shuffle from the end with the seed's draws. For short arrays: each exchange
    goes over the whole array."""
    n = F.size(items)

    def exchanged(held: Column, i: Column) -> Column:
        j = F.floor(draw(seed, n - i) * (i + 1)).cast("int")
        at = lambda x, p: F.when(p == i, F.get(held, j)).when(p == j, F.get(held, i)).otherwise(x)
        return F.transform(held, at)

    places = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, items, exchanged)
