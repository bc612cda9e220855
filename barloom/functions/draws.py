"""Reproducible draws: a pure function of (seed, simulation, row).

Integer arithmetic only, so a retried task, another partitioning or another
engine gives the same number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplicative congruential generator modulo 2^31 - 1.
MODULUS = 2147483647
MULTIPLIER = 48271
STRIDE_A = 7919
STRIDE_B = 104729


def lcg(*parts, seed: int = 42) -> Column:
    """Integer in [0, MODULUS) from a seed and any number of integer columns."""
    x = F.lit(seed).cast("long")
    for p in parts:
        p = F.col(p) if isinstance(p, str) else p
        x = ((x + p.cast("long") * STRIDE_A + STRIDE_B) % MODULUS * MULTIPLIER + STRIDE_B) % MODULUS
    return (x * MULTIPLIER) % MODULUS


def lcg_sql(*parts: str, seed: int = 42) -> str:
    x = f"cast({seed} as bigint)"
    for p in parts:
        x = (
            f"((({x} + cast({p} as bigint) * {STRIDE_A} + {STRIDE_B}) % {MODULUS} * {MULTIPLIER}"
            f" + {STRIDE_B}) % {MODULUS})"
        )
    return f"(({x} * {MULTIPLIER}) % {MODULUS})"


def uniform(*parts, seed: int = 42) -> Column:
    """Uniform in (0, 1)."""
    return (lcg(*parts, seed=seed) + 0.5) / F.lit(float(MODULUS))


def uniform_sql(*parts: str, seed: int = 42) -> str:
    return f"(({lcg_sql(*parts, seed=seed)} + 0.5::double) / {MODULUS}.0::double)"


def normal(*parts, seed: int = 42) -> Column:
    """Standard normal by Box-Muller from two independent streams."""
    u1, u2 = uniform(*parts, seed=seed), uniform(*parts, seed=seed + 1)
    return F.sqrt(-2.0 * F.ln(u1)) * F.cos(2.0 * F.lit(3.141592653589793) * u2)


def normal_sql(*parts: str, seed: int = 42) -> str:
    u1, u2 = uniform_sql(*parts, seed=seed), uniform_sql(*parts, seed=seed + 1)
    return f"(sqrt(-2.0 * ln({u1})) * cos(2.0 * 3.141592653589793::double * {u2}))"


def lcg_array(*parts, seed: int = 42) -> np.ndarray:
    """lcg of integer arrays, which are broadcast against each other."""
    x = np.int64(seed)
    for p in parts:
        x = ((x + p * np.int64(STRIDE_A) + STRIDE_B) % MODULUS * MULTIPLIER + STRIDE_B) % MODULUS
    return (x * MULTIPLIER) % MODULUS


def normal_array(*parts, seed: int = 42) -> np.ndarray:
    u1, u2 = ((lcg_array(*parts, seed=s) + 0.5) / float(MODULUS) for s in (seed, seed + 1))
    return np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * np.pi * u2)
