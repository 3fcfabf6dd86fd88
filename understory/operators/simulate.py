"""Repeatable draws of fitted models inside tasks, for scaled residuals and dispersion tests.

Every uniform number is a hash of the row, the simulation and a counter, so a lost task draws the same numbers again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.operators.trees import hash64
from understory.session import ship_package

#: (row, simulation) pairs drawn at once.
PAIRS = 1 << 18


def uniforms(keys: np.ndarray, counter: int) -> np.ndarray:
    """Numbers in (0, 1) from hashed keys and a counter."""
    h = hash64(keys.ravel(), np.full(keys.size, counter, np.int64)).view(np.uint64)
    return (((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53).reshape(keys.shape)


def gamma_draws(keys: np.ndarray, shape: np.ndarray, counter: int) -> np.ndarray:
    """Gamma variables of unit scale: squeeze of a cubed normal, drawn anew where it is refused; small shapes by a power."""
    lifted = np.where(shape < 1, shape + 1, shape)
    d = lifted - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, open_ = np.zeros(shape.shape), np.arange(shape.size)
    flat_keys, flat_d, flat_c, flat_out = keys.ravel(), d.ravel(), c.ravel(), out.ravel()
    for attempt in range(200):
        if not len(open_):
            break
        k = flat_keys[open_]
        u1, u2, u3 = (uniforms(k, counter + 4 * attempt + j) for j in range(3))
        x = np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)
        v = (1 + flat_c[open_] * x) ** 3
        dd = flat_d[open_]
        with np.errstate(invalid="ignore", divide="ignore"):
            good = (v > 0) & (np.log(u3) < x * x / 2 + dd - dd * v + dd * np.log(v))
        flat_out[open_[good]] = dd[good] * v[good]
        open_ = open_[~good]
    power = np.where(shape < 1, uniforms(keys, counter + 1000) ** (1 / np.minimum(shape, 1)), 1.0)
    return flat_out.reshape(shape.shape) * power


def zero_beta_draws(keys: np.ndarray, zero: np.ndarray, mu: np.ndarray, phi: float) -> np.ndarray:
    """Zero with probability `zero`, else a beta variable of mean `mu` and precision `phi`."""
    a, b = (gamma_draws(keys, np.maximum(s * phi, 1e-8), c) for s, c in ((mu, 10), (1 - mu, 2000)))
    drawn = np.divide(a, a + b, out=np.where(mu > 0.5, 1.0, 0.0), where=a + b > 0)
    return np.where(uniforms(keys, 0) < zero, 0.0, drawn)


def zero_beta_moments(zero, mu, phi):
    """Mean and variance of the zero-inflated beta variable; works on numbers and on columns alike."""
    mean = (1.0 - zero) * mu
    second = (1.0 - zero) * (mu * (1.0 - mu) / (1.0 + phi) + mu * mu)
    return mean, second - mean * mean


def _simulated(df: DataFrame, key: Sequence[str], y: str, zero: str, mu: str, phi: float, sims: int, seed: int):
    """Rows with a hashed key, and a generator of (batch, rows, draws) in tasks."""
    ship_package(df.sparkSession)
    rows = df.withColumn("_key", F.xxhash64(F.lit(seed), *key)).dropna(subset=[y, zero, mu])

    def draws(batches):
        step = max(1, PAIRS // sims)
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.slice(start, step)
                keys = hash64(np.repeat(np.asarray(part["_key"], np.int64), sims), np.tile(np.arange(1, sims + 1), len(part))).reshape(len(part), sims)
                z, m = (np.asarray(part[c], np.float64) for c in (zero, mu))
                yield part, z, m, zero_beta_draws(keys, np.repeat(z[:, None], sims, 1), np.repeat(m[:, None], sims, 1), phi)

    return rows, draws


def zero_beta_residuals(df: DataFrame, key: Sequence[str], y: str, zero: str, mu: str, phi: float, sims: int = 250,
                        seed: int = 0) -> DataFrame:
    """key and scaled_residual: the share of simulated outcomes below the observed one, ties (zeros) split at random.

    `zero` and `mu` are columns of a row's probability of zero and mean above zero. Uniform if the model holds.
    """
    rows, draws = _simulated(df, key, y, zero, mu, phi, sims, seed)

    def run(batches):
        for part, _, _, drawn in draws(batches):
            seen = np.asarray(part[y], np.float64)[:, None]
            below, equal = (drawn < seen).sum(1), (drawn == seen).sum(1)
            scaled = (below + uniforms(np.asarray(part["_key"], np.int64), -1) * equal) / sims
            yield pa.RecordBatch.from_arrays([*[part[c] for c in key], pa.array(scaled)], names=[*key, "scaled_residual"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(*key, "_key", y, zero, mu).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", scaled_residual double")


def zero_beta_dispersion(df: DataFrame, key: Sequence[str], y: str, zero: str, mu: str, phi: float, sims: int = 250,
                         seed: int = 0) -> DataFrame:
    """dispersion and p_value: variance of the residuals over its mean in simulations, and its two-sided place among them.

    Tasks give three sums per simulation; only those are shuffled.
    """
    rows, draws = _simulated(df, key, y, zero, mu, phi, sims, seed)

    def run(batches):
        total = np.zeros((sims + 1, 3))
        for part, z, m, drawn in draws(batches):
            mean, _ = zero_beta_moments(z, m, phi)
            both = np.concatenate([np.asarray(part[y], np.float64)[:, None], drawn], 1) - mean[:, None]
            total += np.stack([np.full(sims + 1, len(part)), both.sum(0), (both**2).sum(0)], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sims + 1), pa.int64()), *[pa.array(c) for c in np.ascontiguousarray(total.T)]],
                                         names=["sim", "n", "s", "ss"])

    sums = (rows.select(*key, "_key", y, zero, mu).mapInArrow(run, "sim bigint, n double, s double, ss double")
            .groupBy("sim").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]))
    var = F.try_divide(F.col("ss") - F.try_divide(F.col("s") * F.col("s"), F.col("n")), F.col("n") - 1)
    each = sums.select("sim", var.alias("v"))
    seen = each.filter("sim = 0").select("v")
    lower, upper = (F.avg(F.when(c, 1.0).otherwise(0.0)) for c in (F.col("v") <= F.col("_seen"), F.col("v") >= F.col("_seen")))
    return each.filter("sim > 0").withColumn("_seen", seen.scalar()).agg(
        F.try_divide(F.max("_seen"), F.avg("v")).alias("dispersion"), F.least(F.lit(1.0), 2.0 * F.least(lower, upper)).alias("p_value"))
