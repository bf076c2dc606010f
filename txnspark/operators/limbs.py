"""Exact sums of doubles: amounts split into integer limbs, one running total per limb.

A double is a whole number times a power of two. ``Limbs`` cuts it at fixed powers into
parts that fit a long with room for all the rows that add up. Sums and differences of
the parts are exact, in any order and over any number of blocks; ``join`` carries them
over and gives the double next to the true sum. How many limbs there are follows the
range of the data: two for amounts in cents, more where tiny and huge amounts meet.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A double has so many bits, and none below the lowest power.
MANTISSA, LOWEST = 53, -1074
#: Bits of a limb when the number of rows is not known: room for 2 ** 34 of them.
SAFE_BITS = 28


def _scaled(x: Column, power: int) -> Column:
    """``x`` times 2 ** power, in steps that are doubles themselves."""
    while abs(power) > 1000:
        step = 1000 if power > 0 else -1000
        x, power = x * F.lit(2.0**step), power - step
    return x * F.lit(2.0**power)


@dataclass(frozen=True)
class Limbs:
    low: int
    bits: int
    count: int

    @staticmethod
    def of(df: DataFrame, column: str, rows: int | None = None) -> Limbs:
        """Limbs for the finite values of a column, at most ``rows`` of which add up. One narrow scan."""
        size = F.abs(F.col(column).cast("double"))
        size = F.when(~F.isnan(size) & (size < F.lit(math.inf)) & (size > 0), size)
        small, large = df.agg(F.min(size), F.max(size)).first()
        bits = SAFE_BITS if rows is None else max(SAFE_BITS, min(50, 61 - max(1, rows).bit_length()))
        if small is None:
            return Limbs(0, bits, 1)
        low = max(math.frexp(small)[1] - MANTISSA, LOWEST)
        return Limbs(low, bits, max(1, math.ceil((math.frexp(large)[1] - low) / bits)))

    def split(self, x: Column) -> list[Column]:
        """Parts of ``x``, the lowest first. What rounding leaves of one part is in the next lower one."""
        parts = []
        for i in range(self.count):
            power = self.low + i * self.bits
            here = F.rint(_scaled(x, -power))
            if i + 1 < self.count:
                above = power + self.bits
                here = here - F.rint(_scaled(x, -above)) * F.lit(2.0**self.bits)
                if above + MANTISSA <= 1023:
                    # So large a value has no bit here, and scaling it could overflow.
                    here = F.when(F.abs(x) < F.lit(math.ldexp(1.0, above + MANTISSA)), here).otherwise(0.0)
            parts.append(here.cast("long"))
        return parts

    def join(self, sums: Sequence[Column]) -> Column:
        """The double of a sum that is given limb by limb."""
        mask = F.lit((1 << self.bits) - 1)
        if self.count <= 3:
            digits, carry = [], None
            for i, s in enumerate(sums):
                now = s if carry is None else s + carry
                carry = F.shiftright(now, self.bits)
                digits.append(now.bitwiseAND(mask) if i + 1 < self.count else now)
        else:
            # An array instead of nested expressions: these double with every limb.
            start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("done"))

            def carried(state: Column, s: Column) -> Column:
                now = s + state["carry"]
                done = F.concat(state["done"], F.array(now.bitwiseAND(mask)))
                return F.struct(F.shiftright(now, self.bits).alias("carry"), done.alias("done"))

            low = F.aggregate(F.array(*sums[:-1]), start, carried)
            digits = [low["done"][i] for i in range(self.count - 1)] + [sums[-1] + low["carry"]]
        parts = [_scaled(d.cast("double"), self.low + i * self.bits) for i, d in enumerate(digits)]
        total = parts[-1]
        for p in reversed(parts[:-1]):
            total = total + p
        return total
