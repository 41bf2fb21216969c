"""Per-series forecasters: seasonal ARIMA by a Kalman filter, Holt-Winters smoothing, and their blend.

A series is one row with an array of at most a few hundred values. Spark deals
the series to tasks; a task filters many series of one length at once, as
stacked numpy arrays, and searches their parameters together.

ARIMA(p, d, q)(P, D, Q, m): the series is differenced, and the rest is an ARMA
process in state-space form. Its Gaussian likelihood comes from the prediction
errors of the filter, started from the stationary distribution; the variance is
concentrated out. Autoregressive and moving-average parameters are searched as
partial correlations, so the process is stationary and invertible.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.constants import MONTH, ROW_KEY, SERIES

# the filters run in workers and travel with the functions that call them
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---- ARIMA

@dataclass(frozen=True)
class Order:
    """(p, d, q) and (P, D, Q, m); a season m below 2 is none."""
    order: tuple[int, int, int] = (1, 1, 1)
    seasonal: tuple[int, int, int, int] = (0, 0, 0, 0)

    @property
    def season(self) -> int:
        return self.seasonal[3] if self.seasonal[3] > 1 else 0

    @property
    def sizes(self) -> tuple[int, int, int, int]:
        """Numbers of autoregressive, moving-average and seasonal parameters."""
        big = (self.seasonal[0], self.seasonal[2]) if self.season else (0, 0)
        return self.order[0], self.order[2], *big

    @property
    def lost(self) -> int:
        """Values that differencing takes from the start of a series."""
        return self.order[1] + (self.seasonal[1] * self.season if self.season else 0)


def differences(y: np.ndarray, o: Order) -> np.ndarray:
    """Rows of series, differenced d times at lag 1 and D times at lag m."""
    for _ in range(o.order[1]):
        y = y[:, 1:] - y[:, :-1]
    for _ in range(o.seasonal[1] if o.season else 0):
        y = y[:, o.season:] - y[:, :-o.season]
    return y


def undifference(y: np.ndarray, ahead: np.ndarray, o: Order) -> np.ndarray:
    """Levels that follow the rows of y, from forecasts of their differences."""
    lags = np.array([1.0])
    for lag, times in ((1, o.order[1]), (o.season, o.seasonal[1] if o.season else 0)):
        for _ in range(times):
            lags = np.convolve(lags, np.concatenate([[1.0], np.zeros(lag - 1), [-1.0]]))
    out = np.concatenate([y, np.zeros_like(ahead)], axis=1)
    n = y.shape[1]
    for h in range(ahead.shape[1]):
        out[:, n + h] = ahead[:, h] - sum(lags[k] * out[:, n + h - k] for k in range(1, len(lags)))
    return out[:, n:]


def from_partial(r: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from partial correlations in (-1, 1); rows are series."""
    phi = np.zeros_like(r)
    for k in range(r.shape[1]):
        before = phi[:, :k].copy()
        phi[:, :k] = before - r[:, k:k + 1] * before[:, ::-1]
        phi[:, k] = r[:, k]
    return phi


def polynomials(x: np.ndarray, o: Order) -> tuple[np.ndarray, np.ndarray]:
    """(phi, theta) of the whole process, seasons multiplied in, from free parameters in rows."""
    p, q, big_p, big_q = o.sizes
    parts, at = [], 0
    for size in (p, q, big_p, big_q):
        parts.append(from_partial(np.tanh(x[:, at:at + size])))
        at += size

    def times(small, big, sign):
        """1 - phi_1 B - ... (sign -1) or 1 + theta_1 B + ... (sign 1), multiplied by the seasonal one; without the leading 1."""
        one = np.ones((len(x), 1))
        a = np.concatenate([one, sign * small], axis=1)
        b = np.zeros((len(x), big.shape[1] * o.season + 1 if big.shape[1] else 1))
        b[:, 0] = 1
        for i in range(big.shape[1]):
            b[:, (i + 1) * o.season] = sign * big[:, i]
        out = np.zeros((len(x), a.shape[1] + b.shape[1] - 1))
        for i in range(a.shape[1]):
            out[:, i:i + b.shape[1]] += a[:, i:i + 1] * b
        return sign * out[:, 1:]

    return times(parts[0], parts[2], -1), times(parts[1], parts[3], 1)


def state_space(phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(T, R, P): transition, loading of the shock, and the stationary variance for shocks of variance 1."""
    b, r = len(phi), max(phi.shape[1], theta.shape[1] + 1, 1)
    t = np.zeros((b, r, r))
    t[:, :phi.shape[1], 0] = phi
    t[:, :-1, 1:] += np.eye(r - 1)
    load = np.zeros((b, r))
    load[:, 0] = 1
    load[:, 1:1 + theta.shape[1]] = theta
    # P = T P T' + R R' by doubling: after k rounds it holds 2**k terms of the sum
    var, power = load[:, :, None] * load[:, None, :], t.copy()
    for _ in range(30):
        new = var + power @ var @ power.transpose(0, 2, 1)
        power = np.clip(power @ power, -1e100, 1e100)
        if np.allclose(new, var, rtol=1e-12, atol=1e-12):
            break
        var = np.clip(new, -1e12, 1e12)
    return t, load, var


def kalman(w: np.ndarray, phi: np.ndarray, theta: np.ndarray, steps: int = 0):
    """(errors, their variances for shocks of variance 1, forecasts) of ARMA rows w."""
    t, load, var = state_space(phi, theta)
    b, n = w.shape
    state = np.zeros((b, t.shape[1]))
    shock = load[:, :, None] * load[:, None, :]
    errors, spread = np.zeros((b, n)), np.ones((b, n))
    for i in range(n):
        f = np.maximum(var[:, 0, 0], 1e-12)
        e = w[:, i] - state[:, 0]
        gain = np.einsum("bij,bj->bi", t, var[:, :, 0]) / f[:, None]
        state = np.einsum("bij,bj->bi", t, state) + gain * e[:, None]
        var = t @ var @ t.transpose(0, 2, 1) + shock - gain[:, :, None] * gain[:, None, :] * f[:, None, None]
        errors[:, i], spread[:, i] = e, f
    ahead = np.zeros((b, steps))
    for h in range(steps):
        ahead[:, h] = state[:, 0]
        state = np.einsum("bij,bj->bi", t, state)
    return errors, spread, ahead


def log_likelihood(errors: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood at the best variance, that variance) per row."""
    n = errors.shape[1]
    s2 = np.maximum((errors ** 2 / spread).mean(axis=1), 1e-300)
    return -0.5 * (n * np.log(2 * np.pi * s2) + np.log(spread).sum(axis=1) + n), s2


def minimise(f, start: np.ndarray, iterations: int) -> np.ndarray:
    """Nelder-Mead for many rows at once; f takes and gives rows."""
    b, k = start.shape
    if not k:
        return start
    simplex = np.repeat(start[:, None, :], k + 1, axis=1)
    simplex[:, np.arange(1, k + 1), np.arange(k)] += 0.4
    value = np.stack([f(simplex[:, i]) for i in range(k + 1)], axis=1)
    row = np.arange(b)
    for _ in range(iterations):
        order = np.argsort(value, axis=1, kind="stable")
        simplex, value = simplex[row[:, None], order], value[row[:, None], order]
        middle, worst = simplex[:, :-1].mean(axis=1), simplex[:, -1]
        turned = middle + (middle - worst)
        f_turned = f(turned)
        # further out where that was best, closer in where it was no help
        far = f_turned < value[:, 0]
        near = f_turned >= value[:, -2]
        outside = f_turned < value[:, -1]
        other = np.where(far[:, None], middle + 2 * (middle - worst), np.where(outside[:, None], middle + 0.5 * (middle - worst), middle - 0.5 * (middle - worst)))
        f_other = f(other)
        take_other = np.where(far, f_other < f_turned, near & (f_other < np.minimum(f_turned, value[:, -1])))
        new, f_new = np.where(take_other[:, None], other, turned), np.where(take_other, f_other, f_turned)
        shrink = near & ~take_other & ~(f_turned < value[:, -1])
        simplex[:, -1] = np.where(shrink[:, None], simplex[:, -1], new)
        value[:, -1] = np.where(shrink, value[:, -1], f_new)
        if shrink.any():
            small = simplex[:, :1] + 0.5 * (simplex - simplex[:, :1])
            f_small = np.stack([f(small[:, i]) for i in range(k + 1)], axis=1)
            simplex = np.where(shrink[:, None, None], small, simplex)
            value = np.where(shrink[:, None], f_small, value)
        if (value.max(axis=1) - value.min(axis=1)).max() < 1e-7:
            break
    return simplex[row, np.argmin(value, axis=1)]


def arima(y: np.ndarray, o: Order, steps: int, iterations: int = 60):
    """(fitted, forecasts, log-likelihood, phi, theta) of rows of one length; fitted repeats the value before where differences are missing."""
    w = differences(y, o)
    scale = np.maximum(w.std(axis=1, keepdims=True), 1e-9)
    unit = w / scale

    def loss(x):
        errors, spread, _ = kalman(unit, *polynomials(x, o))
        value = -log_likelihood(errors, spread)[0]
        return np.where(np.isfinite(value), value, 1e300)

    best = minimise(loss, np.zeros((len(y), sum(o.sizes))), iterations)
    phi, theta = polynomials(best, o)
    errors, spread, ahead = kalman(unit, phi, theta, steps)
    errors, ahead = errors * scale, ahead * scale
    lost = y.shape[1] - w.shape[1]
    fitted = np.concatenate([y[:, :1], y[:, :-1]], axis=1)
    fitted[:, lost:] = y[:, lost:] - errors
    return fitted, undifference(y, ahead, o), log_likelihood(errors, spread)[0], phi, theta


# ---- Holt-Winters

@dataclass(frozen=True)
class Smoothing:
    """Trend and season: add, mul or none."""
    trend: str | None = "add"
    seasonal: str | None = None
    periods: int = 12

    def __post_init__(self):
        if self.trend not in (None, "add", "mul") or self.seasonal not in (None, "add", "mul"):
            raise ValueError("trend and seasonal are 'add', 'mul' or None")

    @property
    def size(self) -> int:
        return 1 + (self.trend is not None) + (self.seasonal is not None)


def _safe(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 1e-9, 1e-9, x)


def holt_winters(y: np.ndarray, s: Smoothing, rates: np.ndarray, steps: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(fitted, forecasts) of rows for given rates (level, trend, season, as far as they are used).

    The level starts at the first value less its season, the trend at the first
    step, the season at the first cycle against its mean.
    """
    b, n = y.shape
    alpha = rates[:, 0]
    beta = rates[:, 1] if s.trend else np.zeros(b)
    gamma = rates[:, -1] if s.seasonal else np.zeros(b)
    m = s.periods if s.seasonal else 1
    if s.seasonal:
        mean = y[:, :m].mean(axis=1, keepdims=True)
        season = y[:, :m] - mean if s.seasonal == "add" else y[:, :m] / _safe(mean)
    else:
        season = np.zeros((b, 1))
    season = season.copy()
    plain = (lambda v, c: v / _safe(c)) if s.seasonal == "mul" else (lambda v, c: v - c)
    dressed = (lambda v, c: v * c) if s.seasonal == "mul" else (lambda v, c: v + c)
    level = plain(y[:, 0], season[:, 0])
    second = plain(y[:, 1], season[:, 1 % m]) if n > 1 else level
    slope = second - level if s.trend == "add" else second / _safe(level) if s.trend == "mul" else np.zeros(b)

    def on(level, slope, k=1):
        return level + k * slope if s.trend == "add" else level * slope ** k if s.trend == "mul" else level

    fitted = np.empty((b, n))
    fitted[:, 0] = y[:, 0]
    for i in range(1, n):
        c = season[:, i % m]
        expected = on(level, slope)
        fitted[:, i] = dressed(expected, c)
        new = alpha * plain(y[:, i], c) + (1 - alpha) * expected
        if s.trend == "add":
            slope = beta * (new - level) + (1 - beta) * slope
        elif s.trend == "mul":
            slope = beta * new / _safe(level) + (1 - beta) * slope
        if s.seasonal == "add":
            season[:, i % m] = gamma * (y[:, i] - new) + (1 - gamma) * c
        elif s.seasonal == "mul":
            season[:, i % m] = gamma * y[:, i] / _safe(new) + (1 - gamma) * c
        level = new
    ahead = np.stack([dressed(on(level, slope, k + 1), season[:, (n + k) % m]) for k in range(steps)], axis=1) if steps else np.zeros((b, 0))
    return fitted, ahead


def smoothed(y: np.ndarray, s: Smoothing, steps: int, iterations: int = 60):
    """(fitted, forecasts, rates) with the rates of least squared error of one step."""
    def loss(x):
        with np.errstate(all="ignore"):
            error = ((y - holt_winters(y, s, 1 / (1 + np.exp(-x)))[0]) ** 2).sum(axis=1)
        return np.where(np.isfinite(error), error, 1e300) / np.maximum((y ** 2).sum(axis=1), 1e-300)

    best = minimise(loss, np.zeros((len(y), s.size)) - 0.5, iterations)
    rates = 1 / (1 + np.exp(-best))
    with np.errstate(all="ignore"):
        return *holt_winters(y, s, rates, steps), rates


# ---- the blend

def blend(a: np.ndarray, b: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Non-negative ridge weights of two forecasts, brought to sum 1."""
    g = np.array([[a @ a + ridge, a @ b], [a @ b, b @ b + ridge]])
    c = np.array([a @ y, b @ y])
    w = np.linalg.solve(g, c)
    if w[0] < 0 or w[1] < 0:
        alone = np.array([max(c[0], 0) / g[0, 0], max(c[1], 0) / g[1, 1]])
        gain = [2 * alone[i] * c[i] - alone[i] ** 2 * g[i, i] for i in (0, 1)]
        w = np.array([alone[0], 0.0]) if gain[0] >= gain[1] else np.array([0.0, alone[1]])
    total = w.sum()
    return (w[0] / total, w[1] / total) if total > 0 else (0.5, 0.5)


@dataclass(frozen=True)
class SeriesForecaster:
    """ARIMA and Holt-Winters per series, blended by their fit to the last ``window`` values.

    A series with fewer than ``min_history`` values, or fewer than differencing
    and one season need, repeats its last value, or decays from a given volume.
    Where a season needs two cycles and the series has fewer, smoothing leaves
    the season out. A forecast that is not finite leaves all weight to the other.
    """
    order: tuple[int, int, int] = (1, 1, 1)
    seasonal_order: tuple[int, int, int, int] = (0, 0, 0, 0)
    trend: str | None = "add"
    seasonal: str | None = None
    seasonal_periods: int = 12
    window: int = 12
    min_history: int = 6
    iterations: int = 60

    def of_length(self, y: np.ndarray, steps: int):
        """(forecasts, weight of ARIMA, weight of smoothing, log-likelihood) of rows of one length."""
        o = Order(self.order, self.seasonal_order)
        n = y.shape[1]
        season = self.seasonal if self.seasonal and n >= 2 * self.seasonal_periods else None
        fit_b, next_b, _ = smoothed(y, Smoothing(self.trend, season, self.seasonal_periods), steps, self.iterations)
        if n - o.lost >= 3:
            fit_a, next_a, likelihood, _, _ = arima(y, o, steps, self.iterations)
        else:
            fit_a, next_a, likelihood = np.full_like(y, np.nan), np.full((len(y), steps), np.nan), np.full(len(y), np.nan)
        out, weights = np.zeros((len(y), steps)), np.zeros((len(y), 2))
        last = slice(max(0, n - self.window), n)
        for i in range(len(y)):
            good = [np.isfinite(f[i, last]).all() and np.isfinite(a[i]).all() for f, a in ((fit_a, next_a), (fit_b, next_b))]
            weights[i] = blend(fit_a[i, last], fit_b[i, last], y[i, last]) if all(good) else (float(good[0]), float(good[1]))
            if any(good):
                out[i] = sum(w * a for w, a in zip(weights[i], (next_a[i], next_b[i])) if w)
            else:
                out[i], weights[i] = y[i, -1], (0.5, 0.5)
        return np.maximum(out, 0.0), weights, likelihood

    def forecast(self, history: DataFrame, months, fallback: DataFrame | None = None, decay_rate: float = 0.05) -> DataFrame:
        """(row key, volume, fitted, weight_ar, weight_holt, log_likelihood) for every series of ``history`` and month of ``months``.

        Rows without a volume are left out, and so are series without any. A
        short series decays from ``fallback`` (series key, avg_vol), or from 1
        where it is missing there; without ``fallback`` it repeats its last
        value.
        """
        wanted, me = [int(m) for m in months], self

        def run(batches):
            for batch in batches:
                series = batch.column("series").to_pylist()
                values = [np.array([v["volume"] for v in s], float) for s in series]
                n, steps = len(values), len(wanted)
                volume, weights, likelihood = np.zeros((n, steps)), np.full((n, 2), 0.5), np.full(n, np.nan)
                fitted = np.array([len(v) >= max(2, me.min_history) for v in values], bool)
                for length in sorted({len(v) for v, f in zip(values, fitted) if f}):
                    rows = [i for i in range(n) if fitted[i] and len(values[i]) == length]
                    for at in range(0, len(rows), 512):
                        some = rows[at:at + 512]
                        volume[some], weights[some], likelihood[some] = me.of_length(np.stack([values[i] for i in some]), steps)
                for i in np.flatnonzero(~fitted):
                    volume[i] = values[i][-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("country"), batch.column("brand_name"), pa.array([wanted] * n, pa.list_(pa.int32())),
                     pa.array(volume.tolist(), pa.list_(pa.float64())), pa.array(fitted.astype(np.int32)), pa.array(weights[:, 0]), pa.array(weights[:, 1]),
                     pa.array(likelihood, mask=~np.isfinite(likelihood))],
                    names=["country", "brand_name", "months", "volumes", "fitted", "weight_ar", "weight_holt", "log_likelihood"])

        known = history.where(F.col("volume").isNotNull()).groupBy(*SERIES).agg(
            F.array_sort(F.collect_list(F.struct(F.col(MONTH).alias("m"), F.col("volume").cast("double").alias("volume")))).alias("series"))
        kinds = ", ".join(f"{c} {history.schema[c].dataType.simpleString()}" for c in SERIES)
        out = known.mapInArrow(run, f"{kinds}, months array<int>, volumes array<double>, fitted int, weight_ar double, weight_holt double, log_likelihood double")
        out = out.withColumn("x", F.explode(F.arrays_zip("months", "volumes"))).select(
            *SERIES, F.col("x.months").alias(MONTH), F.col("x.volumes").alias("volume"), "fitted", "weight_ar", "weight_holt", "log_likelihood")
        if fallback is None:
            return out
        base = fallback.select(*SERIES, F.col("avg_vol").alias("_base"))
        decay = F.coalesce("_base", F.lit(1.0)) * F.exp(-decay_rate * F.col(MONTH))
        return out.join(base, SERIES, "left").withColumn("volume", F.when(F.col("fitted") == 1, F.col("volume")).otherwise(decay)).drop("_base")


def filtered(history: DataFrame, order: Order, phi: list[float], theta: list[float]) -> DataFrame:
    """(series key, n, log_likelihood, variance) of every series under given coefficients of its differenced values."""
    def run(batches):
        for batch in batches:
            found = []
            for s in batch.column("series").to_pylist():
                w = differences(np.array([[v["volume"] for v in s]], float), order) if len(s) > order.lost else np.zeros((1, 0))
                if w.shape[1]:
                    likelihood, s2 = log_likelihood(*kalman(w, np.array([phi], float).reshape(1, -1), np.array([theta], float).reshape(1, -1))[:2])
                    found.append((w.shape[1], float(likelihood[0]), float(s2[0])))
                else:
                    found.append((0, None, None))
            n, likelihood, s2 = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("country"), batch.column("brand_name"), pa.array(n, pa.int32()), pa.array(likelihood, pa.float64()),
                                              pa.array(s2, pa.float64())], names=["country", "brand_name", "n", "log_likelihood", "variance"])

    known = history.where(F.col("volume").isNotNull()).groupBy(*SERIES).agg(
        F.array_sort(F.collect_list(F.struct(F.col(MONTH).alias("m"), F.col("volume").cast("double").alias("volume")))).alias("series"))
    return known.mapInArrow(run, "country string, brand_name string, n int, log_likelihood double, variance double")


def smoothed_by(history: DataFrame, smoothing: Smoothing, rates: list[float], months) -> DataFrame:
    """(row key, volume): Holt-Winters forecasts of every series for given rates."""
    wanted = [int(m) for m in months]

    def run(batches):
        for batch in batches:
            ahead = [holt_winters(np.array([[v["volume"] for v in s]], float), smoothing, np.array([rates], float), len(wanted))[1][0].tolist()
                     for s in batch.column("series").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("country"), batch.column("brand_name"), pa.array(ahead, pa.list_(pa.float64()))],
                                             names=["country", "brand_name", "ahead"])

    known = history.where(F.col("volume").isNotNull()).groupBy(*SERIES).agg(
        F.array_sort(F.collect_list(F.struct(F.col(MONTH).alias("m"), F.col("volume").cast("double").alias("volume")))).alias("series"))
    out = known.mapInArrow(run, "country string, brand_name string, ahead array<double>")
    month = F.element_at(F.array(*[F.lit(m) for m in wanted]), F.col("i") + 1)
    return out.select(*SERIES, F.posexplode("ahead").alias("i", "volume")).select(*SERIES, month.alias(MONTH), "volume").select(*ROW_KEY, "volume")
