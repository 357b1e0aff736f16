"""Keyed permutations of 0..n-1 without sorting.

A mixed-radix Feistel network permutes the a * b pairs (left, right) of a rectangle
that just covers n: each round adds a keyed hash of one half to the other, which is
undone by subtracting it. Numbers from n up (fewer than a are left over) are walked
on: the network is applied again until the result is below n. As a walk meets every
surplus number at most once, ``surplus + 1`` applications always suffice, so that
the result is a permutation for certain; the rectangle is chosen with a small surplus.
Everything is column arithmetic on longs below 2**62: no rank window, no shuffle.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 4
PRIME = 2**31 - 1
FEW = 4  # a surplus that is small enough


@dataclass(frozen=True)
class Permutation:
    """A bijection of 0..n-1 given by ``key``; n below 2**60."""

    n: int
    key: str

    @property
    def sides(self) -> tuple[int, int]:
        """(a, b) with a * b >= n and few numbers left over."""
        low = math.isqrt(max(self.n - 1, 0)) + 1
        best = None
        for a in range(low, low + 4096):
            b = -(-self.n // a) or 1
            surplus = a * b - self.n
            if best is None or surplus < best[0]:
                best = surplus, a, b
            if surplus <= FEW:
                break
        return best[1], best[2]

    def rounds(self) -> list[tuple[int, int]]:
        """Keyed (factor, offset) of each half round."""
        out = []
        for i in range(2 * ROUNDS):
            digest = hashlib.md5(f"{self.key}:{i}".encode()).digest()
            out.append((int.from_bytes(digest[:4], "big") % (PRIME - 1) + 1, int.from_bytes(digest[4:8], "big") % PRIME))
        return out

    @staticmethod
    def _mixed(half, factor: int, offset: int, side: int, mod=lambda x, m: x % m):
        """A hash of ``half`` below ``side``; the same arithmetic on columns and on numbers."""
        x = mod(mod(half, PRIME) * factor + offset, PRIME)
        x = mod(x * x + factor, PRIME)
        return mod(mod(x * x + offset, PRIME), side)

    def _once(self, x, inverse: bool, mod, div):
        a, b = self.sides
        left, right = mod(x, a), div(x, a)
        steps = list(enumerate(self.rounds()))
        for i, (factor, offset) in reversed(steps) if inverse else steps:
            if i % 2 == 0:
                shift = self._mixed(right, factor, offset, a, mod)
                left = mod(left + (a - shift if inverse else shift), a)
            else:
                shift = self._mixed(left, factor, offset, b, mod)
                right = mod(right + (b - shift if inverse else shift), b)
        return right * a + left

    def of_number(self, i: int, inverse: bool = False) -> int:
        """The image of one number, in plain Python."""
        while True:
            i = self._once(i, inverse, lambda x, m: x % m, lambda x, m: x // m)
            if i < self.n:
                return i

    def keys(self, inverse: bool = False) -> Column:
        """The half rounds in the order of their use, as an array literal."""
        rounds = list(enumerate(self.rounds()))
        items = [f"named_struct('even', {str(i % 2 == 0).lower()}, 'f', {f}L, 'o', {o}L)" for i, (f, o) in (reversed(rounds) if inverse else rounds)]
        return F.expr(f"array({', '.join(items)})")

    def dealt(self, df: DataFrame, source: str, out: str, rounds: list[tuple[Column, Column]], inverse: bool = False) -> DataFrame:
        """``df`` with the image of ``source`` as ``out``: :meth:`of` in plain arithmetic, a projection for each step.

        ``rounds``: factor and offset columns of the half rounds in the order of their use.
        """
        a, b = (F.lit(side).cast("long") for side in self.sides)
        prime, kept = F.lit(PRIME).cast("long"), df.columns
        x = F.col(source).cast("long")
        # no operand is negative, so that the remainder is the modulus
        state = df.select(*kept, (x % a).alias("_pl"), F.call_function("div", x, a).alias("_pr"))
        order = list(range(2 * ROUNDS))
        for i, (factor, offset) in zip(reversed(order) if inverse else order, rounds, strict=True):
            changed, fixed, side = ("_pl", "_pr", a) if i % 2 == 0 else ("_pr", "_pl", b)
            state = state.select(*kept, "_pl", "_pr", (((F.col(fixed) % prime) * factor + offset) % prime).alias("_px"))
            state = state.select(*kept, "_pl", "_pr", ((F.col("_px") * F.col("_px") + factor) % prime).alias("_px"))
            shift = ((F.col("_px") * F.col("_px") + offset) % prime) % side
            moved = (F.col(changed) + (side - shift if inverse else shift)) % side
            state = state.select(*kept, *[moved.alias(c) if c == changed else F.col(c) for c in ("_pl", "_pr")])
        state = state.select(*kept, (F.col("_pr") * a + F.col("_pl")).alias("_px"))
        # the few surplus numbers walk on
        keys = F.array(*[F.struct(F.lit(i % 2 == 0).alias("even"), f.alias("f"), o.alias("o")) for i, (f, o) in zip(reversed(order) if inverse else order, rounds, strict=True)])
        walked = self.of(F.col("_px"), inverse, keys)
        image = F.when(F.col("_px") < self.n, F.col("_px")).otherwise(walked)
        # generated, not an alias: the planner would write a join key out through all projections
        return state.select(*kept, F.explode(F.array(image)).alias(out))

    def of(self, column: Column, inverse: bool = False, keys: Column | None = None) -> Column:
        """The image (or with ``inverse`` the origin) of a column of numbers 0..n-1.

        ``keys``: a column with the :meth:`keys` of another permutation of the same n, for
        many permutations in one projection.
        """
        a, b = (F.lit(side).cast("long") for side in self.sides)
        keys = self.keys(inverse) if keys is None else keys
        prime = F.lit(PRIME)

        # lambdas name what is used twice, so that no half round is written out twice
        def half_round(s, k):
            side = F.when(k["even"], a).otherwise(b)
            source = F.when(k["even"], s["r"]).otherwise(s["l"])
            once = F.array(F.pmod(F.pmod(source, prime) * k["f"] + k["o"], prime))
            twice = F.transform(once, lambda x: F.pmod(x * x + k["f"], prime))
            shift = F.transform(twice, lambda x: F.pmod(F.pmod(x * x + k["o"], prime), side))[0]
            shift = side - shift if inverse else shift
            return F.struct(
                F.when(k["even"], F.pmod(s["l"] + shift, side)).otherwise(s["l"]).cast("long").alias("l"),
                F.when(k["even"], s["r"]).otherwise(F.pmod(s["r"] + shift, side)).cast("long").alias("r"),
            )

        def network(x):
            halves = F.struct(F.pmod(x, a).cast("long").alias("l"), F.call_function("div", x, a).cast("long").alias("r"))
            return F.aggregate(keys, halves, half_round, lambda s: s["r"] * a + s["l"])

        x, surplus = column.cast("long"), self.sides[0] * self.sides[1] - self.n
        if not surplus:
            return network(x)

        def step(s, _):
            next_ = F.transform(F.array(network(s["x"])), lambda y: F.struct(y.alias("x"), (y < self.n).alias("done")))[0]
            return F.when(s["done"], s).otherwise(next_)

        steps = F.sequence(F.lit(0), F.lit(surplus))
        return F.aggregate(steps, F.struct(x.alias("x"), F.lit(False).alias("done")), step, lambda s: s["x"])
