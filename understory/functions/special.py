"""Gamma-family functions and densities as JVM-side column expressions.

Spark SQL has no log-gamma, so it is composed from logarithms: the argument is
shifted up by eight with the recurrence and Stirling's series is applied there,
which is good to about 1e-13 for every positive argument.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 8


def _product(factors: list[Column]) -> Column:
    out = factors[0]
    for f in factors[1:]:
        out = out * f
    return out


def lgamma(x: Column) -> Column:
    z = x + F.lit(float(_SHIFT))
    inv = F.lit(1.0) / z
    inv2 = inv * inv
    series = inv * (F.lit(1 / 12) - inv2 * (F.lit(1 / 360) - inv2 * (
        F.lit(1 / 1260) - inv2 * (F.lit(1 / 1680) - inv2 * F.lit(1 / 1188)))))
    stirling = (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series
    return stirling - F.ln(_product([x + F.lit(float(k)) for k in range(_SHIFT)]))


def digamma(x: Column) -> Column:
    z = x + F.lit(float(_SHIFT))
    inv = F.lit(1.0) / z
    inv2 = inv * inv
    tail = inv2 * (F.lit(1 / 12) - inv2 * (F.lit(1 / 120) - inv2 * (
        F.lit(1 / 252) - inv2 * (F.lit(1 / 240) - inv2 * F.lit(1 / 132)))))
    out = F.ln(z) - inv * 0.5 - tail
    for k in range(_SHIFT):
        out = out - F.lit(1.0) / (x + F.lit(float(k)))
    return out


def trigamma(x: Column) -> Column:
    z = x + F.lit(float(_SHIFT))
    inv = F.lit(1.0) / z
    inv2 = inv * inv
    out = inv + inv2 * 0.5 + inv * inv2 * (F.lit(1 / 6) - inv2 * (F.lit(1 / 30) - inv2 * (
        F.lit(1 / 42) - inv2 * (F.lit(1 / 30) - inv2 * F.lit(5 / 66)))))
    for k in range(_SHIFT):
        y = x + F.lit(float(k))
        out = out + F.lit(1.0) / (y * y)
    return out


def inv_logit(eta: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def beta_loglik(y: Column, mu: Column, phi: Column) -> Column:
    """Log-density of a beta variable with mean `mu` and precision `phi`."""
    a, b = mu * phi, (F.lit(1.0) - mu) * phi
    return (lgamma(phi) - lgamma(a) - lgamma(b)
            + (a - 1.0) * F.ln(y) + (b - 1.0) * F.ln(F.lit(1.0) - y))


def bernoulli_loglik(y: Column, eta: Column) -> Column:
    """y*eta - log(1+exp(eta)), written so that large |eta| cannot overflow."""
    return y * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta)))
