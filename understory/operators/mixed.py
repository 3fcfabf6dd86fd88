"""Logit models with nested random intercepts (site, plot within site), fitted by Laplace approximation.

The marginal likelihood splits by site and, given the site effect, by plot. Its value, its gradient and the next step of
the random effects are all sums over rows per plot, then over plots per site, then over sites: three partial aggregates.
Row sums come from the packed rows of a plot (a frequent one has many runs of rows); eliminating the plots of a site and
then the site is closed-form algebra on those sums. A plot's rows lie in one place beside its effects, so a pass shuffles
only sums per site. No site is gathered in one task; the driver gets one row of sums per candidate parameter vector, and
one pass over the rows gives value, gradient and new random effects together.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from understory.functions.special import inv_logit
from understory.operators import glm
from understory.operators.glm import binomial_logit, coef_frame, linear_predictor
from understory.operators.likelihood import beta_rows, bernoulli_rows
from understory.operators.simulate import zero_beta_moments
from understory.session import WRITERS, broadcast_if_small, ship_package, stored
from understory.streaming.incremental import build_once, content_path

LOG_SIGMA_FLOOR = -4.0
STEP = 0.01             # of the differences of gradients that give the covariance
RUN_ROWS = 1 << 12      # rows of a plot in one packed run; a plot with more has many runs
PACKED_PER_CORE = 2     # files of packed plots: passes over them run in as many tasks, or fewer
SETTLED = 1e-5          # log-likelihood that a further step of the random effects may still gain


@dataclass
class MixedFit:
    """Estimates of a fitted model; `modes` holds the random effects as (site, plot, u_site, u_plot).

    `n_rows` were used and `n_dropped` left out for a missing value. `converged` is
    true only if the next step was predicted to gain less than the tolerance.
    """

    family: str
    label: str
    terms: list[str]
    estimate: np.ndarray
    vcov: np.ndarray
    sigma_site: float
    sigma_plot: float
    phi: float | None
    loglik: float
    n_iter: int
    converged: bool
    keys: tuple[str, str]
    n_rows: int
    n_dropped: int
    modes: DataFrame = field(repr=False)

    @property
    def coefs(self) -> dict[str, float]:
        return dict(zip(self.terms, map(float, self.estimate)))

    @property
    def covariance(self) -> dict[tuple[str, str], float]:
        return {(a, b): float(self.vcov[i, j]) for i, a in enumerate(self.terms) for j, b in enumerate(self.terms)}

    @property
    def random_variance(self) -> float:
        return self.sigma_site**2 + self.sigma_plot**2

    @property
    def n_params(self) -> int:
        return len(self.terms) + (3 if self.family == "beta" else 2)

    def coef_table(self) -> DataFrame:
        se = np.sqrt(np.maximum(np.diag(self.vcov), 0))
        return coef_frame(self.modes.sparkSession, self.terms, self.estimate, se)

    def with_fit(self, table: DataFrame) -> DataFrame:
        """A table with how the fit went: rows used and left out, steps, convergence."""
        return table.withColumns({"n_rows": F.lit(self.n_rows), "n_dropped": F.lit(self.n_dropped),
                                  "n_iter": F.lit(self.n_iter), "converged": F.lit(self.converged)})

    def residual_variance(self) -> float:
        """Residual variance on the scale of the logit link."""
        if self.family != "binomial":
            raise ValueError("a beta part has its residual variance with the zero part: ZeroInflatedFit.residual_variance")
        return math.pi**2 / 3

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """Conditional prediction; unseen sites and plots get an effect of zero."""
        site, plot = self.keys
        plots = self.modes.select(F.col("site").alias("_ms"), F.col("plot").alias("_mp"), "u_plot")
        sites = self.modes.groupBy(F.col("site").alias("_ss")).agg(F.max("u_site").alias("u_site"))
        d = df.join(plots, df[site].eqNullSafe(plots["_ms"]) & df[plot].eqNullSafe(plots["_mp"]), "left")
        d = d.join(sites, F.col(site).eqNullSafe(F.col("_ss")), "left")
        u = F.coalesce(F.col("u_site"), F.lit(0.0)) + F.coalesce(F.col("u_plot"), F.lit(0.0))
        return (d.withColumn(out, inv_logit(linear_predictor(self.coefs) + u))
                .drop("_ms", "_mp", "_ss", "u_site", "u_plot"))


@dataclass(frozen=True)
class Algebra:
    """Elimination of plots and sites on arrays of their sums; `p` is the number of fixed effects."""

    family: str
    p: int

    @property
    def m(self) -> int:
        return self.p + (3 if self.family == "beta" else 2)

    def sums(self) -> list[str]:
        """Names of a plot's sums over its rows: density, score, expected and observed information and its slope, their
        derivatives by the log precision, and products with the predictors."""
        return [*_ROW_SUMS, *[f"{n}x{j}" for n in ("g", "w", "t") for j in range(self.p)]]

    def site_sums(self) -> list[str]:
        """Names of a site's sums over its plots."""
        return list(self.eliminated({n: np.ones(1) for n in [*self.sums(), "_v"]}, np.zeros(self.p + 3)))

    def eliminated(self, c: dict[str, np.ndarray], theta: np.ndarray) -> dict[str, np.ndarray]:
        """What each plot adds to its site once its own effect is eliminated."""
        tp, v, t = math.exp(-2 * theta[self.p + 1]), c["_v"], c["t"]
        d, e = np.maximum(c["w"] + tp, tp * 1e-6), c["we"] + tp
        d2, d3, pulled = d * d, d * d * d, 2 * v * tp
        step, de = _stepping(c, tp)
        out = {"n": np.ones_like(d), "l": c["l"], "s": tp * c["w"] / d, "logd": np.log(d), "inv": 1 / d, "w2": c["w"] ** 2 / d2, "v2": v * v,
               "t2": t / d2, "t3": t / d3, "lk": c["lk"], "wk1": c["wk"] / d, "wk2": c["wk"] / d2, "gk": c["gk"] * tp / d,
               "tgk2": t * c["gk"] / d2, "tgk3": t * c["gk"] / d3, "pull": c["w"] * pulled / d, "tp2": t * pulled / d2, "tp3": t * pulled / d3,
               "se": tp * c["we"] / e, "r1": tp * (c["g"] + c["we"] * v) / e, "r2": (c["g"] - v * tp) ** 2 / e,
               "schur": step * tp / de, "rg": c["g"] * tp / de, "rk": c["gk"] * tp / de, "rp": step * v * tp / de}
        for j in range(self.p):
            wx, tx = c[f"wx{j}"], c[f"tx{j}"]
            out |= {f"gx{j}": c[f"gx{j}"], f"a{j}": tp * wx / d, f"tx1_{j}": tx / d, f"tx2_{j}": tx / d2, f"twx2_{j}": t * wx / d2,
                    f"twx3_{j}": t * wx / d3, f"rx{j}": wx * tp / de}
        return out

    def finished(self, s: dict[str, np.ndarray], u: np.ndarray, theta: np.ndarray) -> dict[str, np.ndarray]:
        """What each site adds to the log-likelihood, its gradient, and to what a further step of the effects would gain."""
        ts, tp = (math.exp(-2 * theta[j]) for j in (self.p, self.p + 1))
        big = np.maximum(s["s"] + ts, ts * 1e-6)
        ratio, own = tp * tp / big, tp * s["t2"] + tp**3 / big * s["t3"]
        out = {"value": s["l"] - u * u * ts / 2 - s["v2"] * tp / 2 - theta[self.p] - s["n"] * theta[self.p + 1] - s["logd"] / 2 - np.log(big) / 2,
               "gain": 0.5 * (s["r2"] + (s["r1"] - u * ts) ** 2 / (s["se"] + ts))}
        slopes = [s[f"gx{j}"] - 0.5 * (s[f"tx1_{j}"] + ratio * s[f"tx2_{j}"] - s[f"a{j}"] / big * own - s[f"twx2_{j}"] - ratio * s[f"twx3_{j}"])
                  for j in range(self.p)]
        slopes.append(u * u * ts - 1 + ts / big - u * ts / big * own)
        slopes.append(s["v2"] * tp - s["n"] + tp * (s["inv"] + s["w2"] / big) - 0.5 * (s["tp2"] + ratio * s["tp3"] - s["pull"] / big * own))
        if self.family == "beta":
            slopes.append(s["lk"] - 0.5 * (s["wk1"] + ratio * s["wk2"] + s["gk"] / big * own + s["tgk2"] + ratio * s["tgk3"]))
        return out | {f"g{j}": x for j, x in enumerate(slopes)}

    def moved(self, c: dict[str, np.ndarray], s: dict[str, np.ndarray], u: np.ndarray, theta: np.ndarray, change: np.ndarray):
        """Site and plot effects after a Newton step at theta, carried along to theta + change."""
        p, v = self.p, c["_v"]
        ts, tp = (math.exp(-2 * theta[j]) for j in (p, p + 1))
        step, de = _stepping(c, tp)
        kappa = change[p + 2] if self.family == "beta" else 0.0
        at_site = s["rg"] + s["rk"] * kappa - s["rp"] * (2 * change[p + 1] - 1) - sum(s[f"rx{j}"] * change[j] for j in range(p))
        ds = (at_site + u * ts * (2 * change[p] - 1)) / np.maximum(s["schur"] + ts, 0.1 * ts)
        ds = np.clip(ds, -3, 3)
        at_plot = c["g"] + c["gk"] * kappa + v * tp * (2 * change[p + 1] - 1) - sum(c[f"wx{j}"] * change[j] for j in range(p))
        return u + ds, v + np.clip((at_plot - step * ds) / de, -3, 3)


class _Problem:
    """Prepared rows of one model and the aggregations evaluating candidate parameters."""

    def __init__(self, df: DataFrame, label: str, features: Sequence[str], site: str, plot: str, family: str):
        self.family, self.features = family, list(features)
        x = [F.col(c).cast("double") for c in features]
        rows = df.select(F.col(site).alias("_s"), F.col(plot).alias("_p"), F.col(label).cast("double").alias("_y"),
                         *[c.alias(f"_x{j}") for j, c in enumerate(x)]).dropna()
        stats = rows.agg(F.count(F.lit(1)).alias("n"), F.min("_y").alias("lo"), F.max("_y").alias("hi"),
                         *[f(f"_x{j}").alias(f"{t}{j}") for j in range(len(x))
                           for t, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
        self.n_rows, self.n_dropped = stats["n"], df.count() - stats["n"]
        low, high = stats["lo"], stats["hi"]
        if family == "beta" and not (low > 0 and high < 1):
            raise ValueError("a beta response must lie strictly between 0 and 1")
        if family == "binomial" and not {low, high} <= {0.0, 1.0}:
            raise ValueError("a binomial response must be 0 or 1")
        self.mean = np.array([stats[f"m{j}"] for j in range(len(x))])
        self.scale = np.array([stats[f"s{j}"] or 1.0 for j in range(len(x))])
        z = {f"_x{j}": (F.col(f"_x{j}") - F.lit(float(self.mean[j]))) / F.lit(float(self.scale[j]))
             for j in range(len(x))}
        # read once per step: written to shared storage so every step's plan starts at a scan
        self.rows = stored(rows.withColumns(z) if z else rows, "rows")
        self.p = len(x) + 1
        self.algebra = Algebra(family, self.p)
        self.m = self.algebra.m
        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema}
        self.key_types = f"_s {kinds['_s']}, _p {kinds['_p']}"
        ship_package(df.sparkSession)
        self.runs = self.pack()

    # parameter layout: beta (p), log sigma site, log sigma plot[, log phi]

    def start(self) -> np.ndarray:
        xs = [f"_x{j}" for j in range(self.p - 1)]
        if self.family == "binomial":
            if xs:
                model, _ = binomial_logit(self.rows, "_y", xs)
                beta = [model.intercept, *model.coefficients]
            else:
                m = self.rows.agg(F.avg("_y")).first()[0]
                beta = [math.log(m / (1 - m))]
            return np.array([*beta, math.log(0.3), math.log(0.3)])
        logit = self.rows.withColumn("_l", F.ln(F.col("_y") / (F.lit(1.0) - F.col("_y"))))
        if xs:
            lin = LinearRegression(featuresCol="_v", labelCol="_l").fit(
                VectorAssembler(inputCols=xs, outputCol="_v").transform(logit).select("_v", "_l"))
            beta = [lin.intercept, *lin.coefficients]
        else:
            beta = [logit.agg(F.avg("_l")).first()[0]]
        mu = inv_logit(linear_predictor({"(Intercept)": beta[0]} | dict(zip(xs, beta[1:]))))
        r = self.rows.agg(F.avg(mu * (F.lit(1.0) - mu)).alias("v"),
                          F.avg((F.col("_y") - mu) * (F.col("_y") - mu)).alias("e")).first()
        phi = max(r["v"] / max(r["e"], 1e-12) - 1, 0.5)
        return np.array([*beta, math.log(0.3), math.log(0.3), math.log(phi)])

    def pack(self) -> tuple[DataFrame, DataFrame | None]:
        """Rows of one plot as arrays: a row per plot, and for plots of more than RUN_ROWS rows, if any, runs of that many."""
        p = self.p - 1

        def runs(batches):
            held = None  # the last plot of a batch may go on in the next
            for batch in batches:
                if not batch.num_rows:
                    continue
                if held is not None:
                    batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                start = yield from packed(batch)
                held = batch.slice(start)
            if held is not None and held.num_rows:
                yield all_runs(held, np.array([0, held.num_rows]))

        def packed(batch):
            starts = run_starts(batch)
            if len(starts) > 1:
                yield all_runs(batch, starts)
            return int(starts[-1])

        def run_starts(batch):
            """First rows of the runs of a batch of sorted rows."""
            n = len(batch)
            other = np.zeros(n, bool)
            for key in ("_s", "_p"):
                other[1:] |= np.asarray(pc.not_equal(batch[key].slice(1), batch[key].slice(0, n - 1)))
            other[0] = True
            first = np.flatnonzero(other)
            place = np.arange(n) - np.repeat(first, np.diff(first, append=n))
            return np.flatnonzero(place % RUN_ROWS == 0)

        def all_runs(batch, starts):
            """Runs from each start to the next: their numbers lie side by side already."""
            mine, at = batch.slice(0, int(starts[-1])), pa.array(starts[:-1])
            x = np.stack([np.asarray(mine[f"_x{j}"]) for j in range(p)], 1) if p else np.zeros((len(mine), 0))
            blobs = [pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((starts * (8 * width)).astype(np.int32)), pa.py_buffer(numbers.tobytes())])
                     for numbers, width in ((np.asarray(mine["_y"]), 1), (x, p))]
            return pa.RecordBatch.from_arrays([*[mine[c].take(at) for c in ("_s", "_p", "_large")], *blobs], names=["_s", "_p", "_large", "_ys", "_xs"])

        large = stored(self.rows.groupBy("_s", "_p").count().filter(F.col("count") > RUN_ROWS).select("_s", "_p", F.lit(True).alias("_large")), "large-plots")
        some = large.limit(1).count() > 0
        marked = self.rows.join(broadcast_if_small(large), ["_s", "_p"], "left") if some else self.rows.withColumn("_large", F.lit(None).cast("boolean"))
        salt = F.when(F.col("_large"), F.pmod(F.xxhash64(*self.rows.columns), F.lit(WRITERS))).otherwise(F.lit(0))
        # a number of its own, as each pass works long on few bytes: dealt out by bytes, small tables would lie in one task
        tasks = PACKED_PER_CORE * self.rows.sparkSession.sparkContext.defaultParallelism
        spread = marked.repartition(tasks, "_s", "_p", salt).sortWithinPartitions("_s", "_p")
        found = stored(spread.mapInArrow(runs, f"{self.key_types}, _large boolean, _ys binary, _xs binary"), "runs")
        return (found.filter("_large IS NULL").drop("_large").withColumns({"_u": F.lit(0.0), "_v": F.lit(0.0)}),
                found.filter("_large").drop("_large") if some else None)

    def _beside_sites(self, plots: DataFrame, sites: DataFrame | None) -> DataFrame:
        return plots if sites is None else plots.join(broadcast_if_small(sites.drop("_k", "_su")), ["_s"])

    def _large_sums(self, theta: np.ndarray, large: DataFrame | None, sites: DataFrame | None, changes: Sequence[np.ndarray]) -> DataFrame:
        """Sums of every plot of many runs at theta + change for each change."""
        names, runs = self.algebra.sums(), self.runs[1]
        if large is not None:
            runs = self._beside_sites(runs.join(broadcast_if_small(large.drop("_k")), ["_s", "_p"]), sites)
        fields = f"{self.key_types}, _k int, " + ", ".join(f"`{n}` double" for n in ("_u", "_v", *names))
        return runs.mapInArrow(_Pass(self.algebra, theta, tuple(changes)).run_sums, fields).groupBy("_s", "_p", "_k").agg(
            F.max("_u").alias("_u"), F.max("_v").alias("_v"), *[F.sum(n).alias(n) for n in names])

    def carried(self, theta: np.ndarray, state: tuple | None, change: np.ndarray) -> tuple[DataFrame, DataFrame | None]:
        """Plots with their effects, and sums of those of many runs, at theta + change. A plot's rows stay beside its
        effects, so no plot is shuffled."""
        plots, large, sites = state or (self.runs[0], None, None)
        if state is not None:
            fields = f"{self.key_types}, _ys binary, _xs binary, _u double, _v double"
            plots = stored(self._beside_sites(plots, sites).mapInArrow(_Pass(self.algebra, theta, (change,)).effects, fields), "plots")
        if self.runs[1] is not None:
            large = stored(self._large_sums(theta, large, sites, [change]), "large-sums")
        return plots, large

    def plot_sums(self, theta: np.ndarray, state: tuple, changes: Sequence[np.ndarray]) -> DataFrame:
        """What the plots add to their sites at theta + change for each change, summed per batch of plots; effects are
        carried along from the state at theta. Only these sums are shuffled."""
        plots, large, sites = state
        names = self.algebra.site_sums()
        task = _Pass(self.algebra, theta, tuple(changes))
        fields = f"{self.key_types.split(', ')[0]}, _k int, _su double, " + ", ".join(f"`s_{n}` double" for n in names)
        found = self._beside_sites(plots, sites).mapInArrow(task.eliminated, fields)
        if large is not None:
            at = large if sites is None else self._large_sums(theta, large, sites, changes)
            found = found.unionByName(at.mapInArrow(task.eliminated_sums, fields))
        return found

    def totals(self, thetas: Sequence[np.ndarray], plots: DataFrame, keep: bool = False) -> tuple[list[dict], DataFrame]:
        """Per candidate the Laplace log-likelihood, its gradient, and what a further step of the effects would gain; and
        the sums of the sites, written if they are to be kept. Plots are eliminated first, then sites."""
        algebra, site_names = self.algebra, self.algebra.site_sums()
        sites = plots.groupBy("_s", "_k").agg(F.max("_su").alias("_su"), *[F.sum(f"s_{n}").alias(f"s_{n}") for n in site_names])
        sites = stored(sites, "sites") if keep else sites
        ends = ["value", "gain", *[f"g{j}" for j in range(self.m)]]

        def per_site(batches):
            for batch in batches:
                which, u = np.asarray(batch["_k"]), np.asarray(batch["_su"])
                columns = {n: np.asarray(batch[f"s_{n}"]) for n in site_names}
                rows = []
                for k in np.unique(which):
                    mine = which == k
                    out = algebra.finished({n: v[mine] for n, v in columns.items()}, u[mine], thetas[k])
                    rows.append([out[n].sum() for n in ends])
                table = np.array(rows).reshape(-1, len(ends))
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(which), pa.int32()), *[pa.array(x) for x in np.ascontiguousarray(table.T)]],
                                                 names=["_k", *ends])

        found = sites.mapInArrow(per_site, "_k int, " + ", ".join(f"{n} double" for n in ends))
        out = [None] * len(thetas)
        for r in found.groupBy("_k").agg(*[F.sum(n).alias(n) for n in ends]).collect():  # one row per candidate
            out[r["_k"]] = {"value": r["value"] + r["gain"], "gain": r["gain"], "grad": np.array([r[f"g{j}"] for j in range(self.m)])}
        return out, sites

    def settle(self, theta: np.ndarray, state=None, change: np.ndarray | None = None, enough: float = SETTLED, most: int = 8) -> tuple[dict, tuple]:
        """Totals and state at theta + change once the random effects gain no more than `enough` by a further step."""
        change = np.zeros_like(theta) if change is None else change
        for _ in range(most):
            plots = self.carried(theta, state, change)
            theta, change = theta + change, np.zeros_like(theta)
            (at,), sites = self.totals([theta], self.plot_sums(theta, (*plots, None), [change]), keep=True)
            state = (*plots, sites)
            if at["gain"] <= enough or not np.isfinite(at["value"]):
                break
        return at, state

    def hessian(self, theta: np.ndarray, state: tuple) -> np.ndarray:
        """Central differences of the gradient, all in one pass over the rows."""
        near = [sign * STEP * np.eye(self.m)[i] for i in range(self.m) for sign in (1, -1)]
        moved, _ = self.totals([theta + n for n in near], self.plot_sums(theta, state, near))
        hess = np.array([(moved[2 * i]["grad"] - moved[2 * i + 1]["grad"]) / (2 * STEP) for i in range(self.m)])
        return (hess + hess.T) / 2


@dataclass(frozen=True)
class _Pass:
    """A pass over packed plots in tasks, from the effects at theta to theta + change for each change.

    Batches with sums of their sites (`s_...`) first move the effects; without, the effects are those at theta + change.
    """

    algebra: Algebra
    theta: np.ndarray
    changes: tuple[np.ndarray, ...]

    def _opened(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        y, sizes = _numbers(batch["_ys"])
        x = _numbers(batch["_xs"])[0].reshape(len(y), self.algebra.p - 1)
        x = np.concatenate([np.ones((len(y), 1)), x], 1)
        return y, x, np.ascontiguousarray(x.T), sizes

    def _sums(self, opened, at: np.ndarray, effects: np.ndarray) -> dict[str, np.ndarray]:
        (y, x, columns, sizes), p = opened, self.algebra.p
        eta = x @ at[:p] + np.repeat(effects, sizes)
        of = beta_rows(y, eta, math.exp(min(at[p + 2], 30.0))) if self.algebra.family == "beta" else bernoulli_rows(y, eta)
        first = np.cumsum(sizes) - sizes
        found = [np.add.reduceat(of[n], first) for n in _ROW_SUMS]
        found += [np.add.reduceat(of[n] * columns[j], first) for n in ("g", "w", "t") for j in range(p)]
        return dict(zip(self.algebra.sums(), found))

    def _moved(self, batch: pa.RecordBatch, opened):
        """Site and plot effects at theta + change, for each change."""
        names = batch.schema.names
        if "_u" not in names:
            u = v = np.zeros(len(batch))
        else:
            u, v = np.asarray(batch["_u"]), np.asarray(batch["_v"])
        if "s_n" not in names:
            return [(u, v)] * len(self.changes)
        # sums over all runs of a plot come with it; those of a plot of one run are found again
        c = ({n: np.asarray(batch[n]) for n in self.algebra.sums()} if "l" in names else self._sums(opened, self.theta, u + v)) | {"_v": v}
        s = {n: np.asarray(batch[f"s_{n}"]) for n in self.algebra.site_sums()}
        return [self.algebra.moved(c, s, u, self.theta, change) for change in self.changes]

    def effects(self, batches):
        for batch in batches:
            if len(batch):
                ((u, v),) = self._moved(batch, self._opened(batch))
                yield pa.RecordBatch.from_arrays([batch[n] for n in ("_s", "_p", "_ys", "_xs")] + [pa.array(u), pa.array(v)],
                                                 names=["_s", "_p", "_ys", "_xs", "_u", "_v"])

    def run_sums(self, batches):
        for batch in batches:
            if not len(batch):
                continue
            opened = self._opened(batch)
            for k, (change, (u, v)) in enumerate(zip(self.changes, self._moved(batch, opened))):
                sums = self._sums(opened, self.theta + change, u + v)
                yield pa.RecordBatch.from_arrays([batch["_s"], batch["_p"], pa.array(np.full(len(batch), k), pa.int32()), pa.array(u), pa.array(v),
                                                  *[pa.array(x) for x in sums.values()]], names=["_s", "_p", "_k", "_u", "_v", *sums])

    def eliminated(self, batches):
        for batch in batches:
            if not len(batch):
                continue
            opened = self._opened(batch)
            for k, (change, (u, v)) in enumerate(zip(self.changes, self._moved(batch, opened))):
                yield self._by_site(batch["_s"], k, u, self._sums(opened, self.theta + change, u + v) | {"_v": v})

    def eliminated_sums(self, batches):
        names = [*self.algebra.sums(), "_v"]
        for batch in batches:
            which = np.asarray(batch["_k"])
            for k in np.unique(which):
                mine = batch.take(pa.array(np.flatnonzero(which == k)))
                yield self._by_site(mine["_s"], int(k), np.asarray(mine["_u"]), {n: np.asarray(mine[n]) for n in names})

    def _by_site(self, site: pa.Array, k: int, u: np.ndarray, c: dict[str, np.ndarray]) -> pa.RecordBatch:
        """What the plots of a batch add to their sites."""
        sites = site.dictionary_encode()
        codes, n = np.asarray(sites.indices), len(sites.dictionary)
        first = np.unique(codes, return_index=True)[1]
        out = self.algebra.eliminated(c, self.theta + self.changes[k])
        return pa.RecordBatch.from_arrays(
            [sites.dictionary, pa.array(np.full(n, k), pa.int32()), pa.array(u[first]), *[pa.array(np.bincount(codes, x, n)) for x in out.values()]],
            names=["_s", "_k", "_su", *[f"s_{name}" for name in out]])


def _numbers(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed numbers, one after another, and how many each has."""
    _, bounds, data = blobs.buffers()
    kind = np.int64 if pa.types.is_large_binary(blobs.type) else np.int32
    at = np.frombuffer(bounds, kind)[blobs.offset:blobs.offset + len(blobs) + 1]
    sizes = np.diff(at) // 8
    return np.frombuffer(data or b"", "<f8", int(sizes.sum()), int(at[0]) if data else 0), sizes


_ROW_SUMS = ("l", "g", "we", "w", "t", "lk", "gk", "wk")


def _stepping(c: dict[str, np.ndarray], tp: float) -> tuple[np.ndarray, np.ndarray]:
    """Information to step by, and with the plot's precision: observed (exact near the mode), expected where that is too small."""
    step = np.where(c["w"] + tp >= (c["we"] + tp) * 0.1, c["w"], c["we"])
    return step, step + tp


def fit_mixed(df: DataFrame, label: str, features: Sequence[str], site: str = "site", plot: str = "plot_id",
              family: str = "binomial", max_iter: int = 25, tol: float = 1e-4) -> MixedFit:
    """Maximum Laplace likelihood of `label ~ features + (1 | site/plot)` with logit link.

    `family` is 'binomial' for 0/1 or 'beta' for a response inside (0, 1). Rows
    with a missing value are left out. Newton steps, with the exact gradient and
    its differences as Hessian, stop when the next one is predicted to gain less
    than `tol` log-likelihood units. Standard errors come from the inverse
    Hessian of the marginal likelihood.
    """
    prob = _Problem(df, label, features, site, plot, family)
    theta, p, m = prob.start(), prob.p, prob.m
    at, state = prob.settle(theta)
    converged, n_iter = False, 0

    def at_floor(i: int) -> bool:
        return p <= i <= p + 1 and theta[i] <= LOG_SIGMA_FLOOR + 1e-9

    while True:
        hess = prob.hessian(theta, state)
        free = np.array([not (at_floor(i) and at["grad"][i] < 0) for i in range(m)])
        delta = np.zeros(m)
        delta[free] = _inverse(-hess[np.ix_(free, free)]) @ at["grad"][free]
        gain = 0.5 * float(at["grad"] @ delta)  # predicted, in log-likelihood
        converged = gain < tol
        if converged or n_iter == max_iter:
            break
        n_iter += 1
        delta /= max(1.0, np.abs(delta).max())
        for j in (p, p + 1):  # a variance that keeps shrinking is tried at its end
            if theta[j] < -2 and delta[j] < -0.3:
                delta[j] = LOG_SIGMA_FLOOR - theta[j]
        for _ in range(6):
            t = theta + delta
            t[p:p + 2] = np.maximum(t[p:p + 2], LOG_SIGMA_FLOOR)
            new, new_state = prob.settle(theta, state, t - theta, max(SETTLED, 1e-3 * gain))
            if new["value"] > at["value"] - tol / 10:
                break
            delta = delta / 4
        else:  # the predicted gain isn't there along the step: not converged
            break
        theta, at, state = t, new, new_state
    free = np.array([not at_floor(i) for i in range(m)])
    cov = np.zeros((m, m))
    cov[np.ix_(free, free)] = np.linalg.pinv(-hess[np.ix_(free, free)])

    # back from standardized predictors
    to_raw = np.eye(p)
    to_raw[0, 1:] = -prob.mean / prob.scale
    to_raw[1:, 1:] = np.diag(1 / prob.scale)
    out = reduce(DataFrame.union, [plots.select(F.col("_s").alias("site"), F.col("_p").alias("plot"), F.col("_u").alias("u_site"), F.col("_v").alias("u_plot"))
                                   for plots in state[:2] if plots is not None])
    return MixedFit(family, label, ["(Intercept)", *features], to_raw @ theta[:p], to_raw @ cov[:p, :p] @ to_raw.T,
                    math.exp(theta[p]), math.exp(theta[p + 1]), math.exp(theta[p + 2]) if family == "beta" else None,
                    float(at["value"]), n_iter, converged, (site, plot), prob.n_rows, prob.n_dropped, out)


def _inverse(info: np.ndarray) -> np.ndarray:
    """Inverse of a symmetric matrix, its eigenvalues lifted to be positive."""
    value, vector = np.linalg.eigh(info)
    return vector @ np.diag(1 / np.maximum(np.abs(value), 1e-6 * max(1.0, np.abs(value).max()))) @ vector.T


@dataclass
class ZeroInflatedFit:
    """Zero part (probability of a zero) and conditional beta part."""

    zero: MixedFit
    cond: MixedFit
    n_ones: int = 0

    def coef_table(self) -> DataFrame:
        parts = [f.coef_table().withColumns({"component": F.lit(n), "effect": F.lit("fixed")})
                 for n, f in (("cond", self.cond), ("zi", self.zero))]
        return parts[0].unionByName(parts[1])

    @property
    def loglik(self) -> float:
        return self.zero.loglik + self.cond.loglik

    @property
    def n_params(self) -> int:
        return self.zero.n_params + self.cond.n_params

    def with_fit(self, table: DataFrame) -> DataFrame:
        """A table with how the fit went: rows of both parts, rows of 1 left out, steps, convergence of both."""
        return table.withColumns({
            "n_rows": F.lit(self.zero.n_rows), "n_positive": F.lit(self.cond.n_rows), "n_dropped": F.lit(self.zero.n_dropped),
            "n_ones_dropped": F.lit(self.n_ones), "n_iter": F.lit(max(self.zero.n_iter, self.cond.n_iter)),
            "converged": F.lit(self.zero.converged and self.cond.converged)})

    def parts(self, df: DataFrame, zero: str = "p_zero", mu: str = "mu") -> DataFrame:
        """Conditional predictions of both parts: probability of a zero, and mean above zero."""
        return self.zero.predict(self.cond.predict(df, mu), zero)

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """Expected response: probability of being non-zero times the conditional mean."""
        d = self.parts(df, "_z", "_c")
        return d.withColumn(out, (F.lit(1.0) - F.col("_z")) * F.col("_c")).drop("_c", "_z")

    def residual_variance(self, df: DataFrame) -> float:
        """ln(1 + cv^2) of the response, with the precision and the zeros, at the means of both parts' fixed effects."""
        at = df.agg(*[F.avg(inv_logit(linear_predictor(f.coefs))).alias(n) for n, f in (("z", self.zero), ("c", self.cond))]).first()
        mean, variance = zero_beta_moments(at["z"], at["c"], self.cond.phi)
        return math.log1p(variance / mean**2)

    def r_squared(self, df: DataFrame) -> DataFrame:
        """Marginal and conditional R2 of the conditional part."""
        return glm.r_squared(df, self.cond.coefs, self.cond.random_variance, self.residual_variance(df))

    def overdispersion(self, df: DataFrame, label: str) -> DataFrame:
        """Squared Pearson residuals over the residual degrees of freedom, with both parts' mean and variance."""
        mean, variance = zero_beta_moments(F.col("p_zero"), F.col("mu"), F.lit(float(self.cond.phi)))
        return glm.overdispersion(self.parts(df), F.col(label), mean, variance, self.n_params)


def fit_zero_inflated_beta(df: DataFrame, label: str, features: Sequence[str], zero_features: Sequence[str] = (),
                           site: str = "site", plot: str = "plot_id", drop_ones: bool = False,
                           **params) -> ZeroInflatedFit:
    """Zero-inflated beta model with random intercepts in both parts.

    A beta variable is never 0, so the likelihood splits into a logit model of
    y = 0 on all rows and a beta model on the positive rows. It is never 1
    either: such rows are an error, unless `drop_ones` leaves them out of both
    parts; `n_ones` tells how many they were.
    """
    y = F.col(label)
    n_ones = df.filter(y == 1).count()
    rows = df.filter(y.isNotNull() & (y < 1)) if drop_ones else df.filter(y.isNotNull())
    parts = ((rows.withColumn("_is_zero", (y == 0).cast("double")), "_is_zero", zero_features, "binomial"),
             (rows.filter(y > 0), label, features, "beta"))

    def fit(part):
        frame, response, terms, family = part
        return fit_mixed(frame, response, terms, site, plot, family, **params)

    with ThreadPoolExecutor(2) as pool:  # the two parts have no parameter in common
        zero, cond = pool.map(inheritable_thread_target(fit), parts)
    return ZeroInflatedFit(zero, cond, n_ones if drop_ones else 0)


def save_fit(fit: MixedFit | ZeroInflatedFit, path: str) -> None:
    """Write a fit below `path`: the random effects as a table, all else in a manifest that is written last."""
    if isinstance(fit, ZeroInflatedFit):
        for name, part in (("zero", fit.zero), ("cond", fit.cond)):
            save_fit(part, f"{path}/{name}")
        spark, known = fit.zero.modes.sparkSession, {"n_ones": fit.n_ones}
    else:
        fit.modes.write.parquet(f"{path}/modes")
        spark = fit.modes.sparkSession
        known = {k: getattr(fit, k) for k in _SAVED} | {"estimate": list(map(float, fit.estimate)), "vcov": np.asarray(fit.vcov).tolist()}
    spark.createDataFrame([(json.dumps(known),)], "manifest string").coalesce(1).write.text(f"{path}/manifest")


def load_fit(spark: SparkSession, path: str) -> MixedFit | ZeroInflatedFit:
    """A saved fit that predicts, tests and explains as when it was fitted."""
    known = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if "n_ones" in known:
        return ZeroInflatedFit(load_fit(spark, f"{path}/zero"), load_fit(spark, f"{path}/cond"), known["n_ones"])
    estimate, vcov, keys = np.array(known.pop("estimate")), np.array(known.pop("vcov")), tuple(known.pop("keys"))
    return MixedFit(estimate=estimate, vcov=vcov, keys=keys, modes=spark.read.parquet(f"{path}/modes"), **known)


_SAVED = ("family", "label", "terms", "sigma_site", "sigma_plot", "phi", "loglik", "n_iter", "converged", "keys", "n_rows", "n_dropped")


def saved_fit(rows: DataFrame, name: str, build: Callable[[DataFrame], MixedFit | ZeroInflatedFit]) -> MixedFit | ZeroInflatedFit:
    """The fit of these stored rows: read if it has been made, else made and saved under a digest of the rows and the name."""
    path = build_once(rows.sparkSession, content_path(rows, name, name), lambda fresh: save_fit(build(rows), fresh))
    return load_fit(rows.sparkSession, path)
