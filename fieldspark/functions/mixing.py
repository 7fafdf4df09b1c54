"""splitmix64, the seeded order of ties and folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The increment and the two multipliers of splitmix64.
INCREMENT, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _lo(x: Column, bits: int = 32) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def times(x: Column, factor: int) -> Column:
    """x * factor modulo 2^64 for signed longs: by 16-bit limbs of x, none of whose products overflows a long."""
    high, low = factor >> 32, factor & 0xFFFFFFFF
    addends = []
    for k in range(4):
        limb = F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0xFFFF))
        addends.append(F.shiftleft(limb * F.lit(low), 16 * k))
        if 16 * k + 32 < 64:
            addends.append(F.shiftleft(_lo(limb * F.lit(high)), 16 * k + 32))
    return F.aggregate(F.array(*addends), F.lit(0).cast("long"), wrapping)


def wrapping(a: Column, b: Column) -> Column:
    """a + b modulo 2^64: by halves, as a sum of longs may overflow."""
    low = _lo(a) + _lo(b)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(_lo(high), 32).bitwiseOR(_lo(low))


def splitmix64(x: Column) -> Column:
    """The mixed bits of a long, as a signed long."""
    # each step is bound by a transform, lest its expression be written out many times over
    step = lambda c, f: F.get(F.transform(F.array(c), f), 0)
    z = step(x, lambda v: wrapping(v, F.lit(_signed(INCREMENT))))
    z = step(z, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 30)))
    z = step(z, lambda v: times(v, FIRST))
    z = step(z, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 27)))
    z = step(z, lambda v: times(v, SECOND))
    return step(z, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 31)))


def unsigned_order(x: Column) -> Column:
    """Sorts as the unsigned value of a long does."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def plain(x: int) -> int:
    mask = (1 << 64) - 1
    z = (x + INCREMENT) & mask
    z = ((z ^ z >> 30) * FIRST) & mask
    z = ((z ^ z >> 27) * SECOND) & mask
    return z ^ z >> 31
