"""Deterministic per-row noise derived from a hash of the row key.

numpy draws are not reproducible across partitionings, so noise here is a
pure function of (key, seed, tag): re-running a task after an executor loss
gives the same values.  ``std = 0`` (the tested default) adds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import ColumnOrName, unit_uniform

#: Rates above this are drawn in parts.
LARGEST_RATE = 500.0


def gaussian(key: ColumnOrName, seed: int = 42, tag: str = "", std: float = 1.0) -> Column:
    """N(0, std) by Box-Muller from two hash uniforms."""
    u1 = unit_uniform(key, seed, tag + "/u1")
    u2 = unit_uniform(key, seed, tag + "/u2")
    z = F.sqrt(-2.0 * F.log(F.greatest(u1, F.lit(1e-300)))) * F.cos(2.0 * math.pi * u2)
    return z * float(std)


def uniform(key: ColumnOrName, lo: float, hi: float, seed: int = 42, tag: str = "") -> Column:
    return F.lit(float(lo)) + unit_uniform(key, seed, tag) * float(hi - lo)


def poisson(key: ColumnOrName, lam: ColumnOrName | float, seed: int = 42, tag: str = "") -> Column:
    """Poisson(lam) by inverse CDF with the recurrence p_k = p_(k-1) * lam / k.

    The recurrence runs as far as a 53-bit uniform can reach at the row's own rate, so no
    draw is cut.  exp(-lam) vanishes for large rates: above ``LARGEST_RATE`` the rate is split
    evenly and the independent draws of its parts are added up.
    """
    lam_c = F.lit(float(lam)) if isinstance(lam, (int, float)) else (F.col(lam) if isinstance(lam, str) else lam)
    key_c = F.col(key) if isinstance(key, str) else key
    first = unit_uniform(key, seed, tag)

    def drawn(row):
        parts = F.greatest(F.ceil(row["lam"] / LARGEST_RATE), F.lit(1)).cast("int")

        def part(total, i):
            u = F.when(i == 1, row["u"]).otherwise(unit_uniform(F.xxhash64(key_c, i), seed, tag))
            return total + _poisson_draw(u, row["lam"] / parts)

        return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), part)

    return F.when(lam_c.isNotNull(), _once(F.struct(lam_c.alias("lam"), first.alias("u")), drawn))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` reads it: a lambda's variable is, a
    column expression inside a lambda is evaluated anew at every step."""
    return F.transform(F.array(value), body)[0]


def _poisson_draw(u: Column, lam: Column) -> Column:
    """The smallest k whose cumulative probability exceeds ``u``.  Few draws go past the rate and two deviations; only
    those walk on to the end."""

    def drawn(row):
        lam, u = row["lam"], row["u"]
        p0 = F.exp(-lam)
        init = F.struct(p0.alias("p"), p0.alias("cdf"), F.when(u < p0, F.lit(0)).otherwise(F.lit(-1)).alias("res"))

        def step(acc, k):
            p = acc["p"] * lam / k.cast("double")
            cdf = acc["cdf"] + p
            res = F.when(acc["res"] >= 0, acc["res"]).when(u < cdf, k).otherwise(F.lit(-1))
            return F.struct(p.alias("p"), cdf.alias("cdf"), res.alias("res"))

        near = F.ceil(lam + 2 * F.sqrt(lam) + 3).cast("int")
        reach = F.ceil(lam + 12 * F.sqrt(lam) + 40).cast("int")
        far = lambda acc: F.when(acc["res"] >= 0, acc["res"]).otherwise(
            F.aggregate(F.sequence(near + 1, reach), acc, step)["res"])
        out = _once(F.aggregate(F.sequence(F.lit(1), near), init, step), far)
        return _once(out, lambda k: F.when(k < 0, reach).otherwise(k).cast("int"))

    return _once(F.struct(lam.alias("lam"), u.alias("u")), drawn)


def integer_jitter(key: ColumnOrName, seed: int = 42, tag: str = "") -> Column:
    """Uniform integer in {-1, 0, 1}."""
    return (F.floor(unit_uniform(key, seed, tag) * 3.0) - 1).cast("int")
