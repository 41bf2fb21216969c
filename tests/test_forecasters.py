import numpy as np
import pytest

from panelspark.operators import forecasters as fc


def dense_likelihood(w, phi, theta):
    """Concentrated Gaussian likelihood from the whole covariance matrix, its entries from a long moving average."""
    psi = np.zeros(4000)
    for j in range(len(psi)):
        psi[j] = (1.0 if j == 0 else theta[j - 1] if j <= len(theta) else 0.0) + sum(phi[i] * psi[j - i - 1] for i in range(min(len(phi), j)))
    n = len(w)
    gamma = np.array([psi[:len(psi) - k] @ psi[k:] for k in range(n)])
    cov = gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    s2 = w @ np.linalg.solve(cov, w) / n
    return -0.5 * (n * np.log(2 * np.pi * s2) + np.linalg.slogdet(cov)[1] + n), s2, cov


@pytest.mark.parametrize("order,seasonal", [((1, 0, 0), (0, 0, 0, 0)), ((0, 0, 1), (0, 0, 0, 0)), ((2, 0, 1), (0, 0, 0, 0)), ((1, 1, 1), (0, 0, 0, 0)),
                                            ((1, 0, 1), (1, 0, 1, 4)), ((0, 1, 1), (0, 1, 1, 6)), ((0, 1, 0), (0, 0, 0, 0))])
def test_likelihood_and_forecasts_equal_the_dense_ones(order, seasonal):
    rng = np.random.default_rng(4)
    o = fc.Order(order, seasonal)
    y = 50 + np.cumsum(rng.normal(size=(3, 40)), axis=1)
    x = rng.normal(scale=0.5, size=(3, sum(o.sizes)))
    phi, theta = fc.polynomials(x, o)
    w = fc.differences(y, o)
    assert w.shape[1] == 40 - o.lost
    errors, spread, ahead = fc.kalman(w, phi, theta, 5)
    got, s2 = fc.log_likelihood(errors, spread)
    for i in range(3):
        value, variance, cov = dense_likelihood(w[i], phi[i], theta[i])
        assert np.isclose(got[i], value, rtol=1e-6) and np.isclose(s2[i], variance, rtol=1e-6)
        # the forecast is the conditional mean given all values
        longer = dense_likelihood(np.zeros(w.shape[1] + 5) + 1, phi[i], theta[i])[2]
        n = w.shape[1]
        assert np.allclose(ahead[i], longer[n:, :n] @ np.linalg.solve(cov, w[i]), atol=1e-6)
    # levels: differences of history and forecast together are the forecasts of the differences
    level = fc.undifference(y, ahead, o)
    assert np.allclose(fc.differences(np.concatenate([y, level], axis=1), o)[:, -5:], ahead)


def holt_winters_by_hand(y, trend, seasonal, m, alpha, beta, gamma, steps):
    s = [0.0] if not seasonal else ([v - np.mean(y[:m]) for v in y[:m]] if seasonal == "add" else [v / np.mean(y[:m]) for v in y[:m]])
    m = len(s)
    off = (lambda v, c: v / c) if seasonal == "mul" else (lambda v, c: v - c)
    on = (lambda v, c: v * c) if seasonal == "mul" else (lambda v, c: v + c)
    level = off(y[0], s[0])
    second = off(y[1], s[1 % m])
    slope = second - level if trend == "add" else second / level if trend == "mul" else None
    fitted = [y[0]]
    for t in range(1, len(y)):
        expected = level + slope if trend == "add" else level * slope if trend == "mul" else level
        fitted.append(on(expected, s[t % m]))
        new = alpha * off(y[t], s[t % m]) + (1 - alpha) * expected
        if trend == "add":
            slope = beta * (new - level) + (1 - beta) * slope
        if trend == "mul":
            slope = beta * new / level + (1 - beta) * slope
        if seasonal == "add":
            s[t % m] = gamma * (y[t] - new) + (1 - gamma) * s[t % m]
        if seasonal == "mul":
            s[t % m] = gamma * y[t] / new + (1 - gamma) * s[t % m]
        level = new
    ahead = [on(level + (h + 1) * slope if trend == "add" else level * slope ** (h + 1) if trend == "mul" else level, s[(len(y) + h) % m]) for h in range(steps)]
    return fitted, ahead


@pytest.mark.parametrize("trend", [None, "add", "mul"])
@pytest.mark.parametrize("seasonal", [None, "add", "mul"])
def test_holt_winters_equals_its_recursion(trend, seasonal):
    rng = np.random.default_rng(5)
    y = 20 + 5 * np.sin(np.arange(30) / 2) + rng.normal(size=(4, 30))
    s = fc.Smoothing(trend, seasonal, 6)
    rates = rng.uniform(0.1, 0.6, size=(4, s.size))
    fitted, ahead = fc.holt_winters(y, s, rates, 8)
    for i in range(4):
        beta = rates[i, 1] if trend else 0.0
        want = holt_winters_by_hand(y[i].tolist(), trend, seasonal, 6, rates[i, 0], beta, rates[i, -1], 8)
        assert np.allclose(fitted[i], want[0]) and np.allclose(ahead[i], want[1])


def test_search_finds_the_process():
    rng = np.random.default_rng(6)
    e = rng.normal(size=(6, 400))
    w = np.zeros_like(e)
    for t in range(1, 400):
        w[:, t] = 0.7 * w[:, t - 1] + e[:, t]
    _, _, likelihood, phi, _ = fc.arima(w, fc.Order((1, 0, 0)), 3)
    assert np.abs(phi[:, 0] - 0.7).max() < 0.15
    for x in (-0.3, 0.3):
        other = fc.log_likelihood(*fc.kalman(w, np.clip(phi + x, -0.99, 0.99), np.zeros((6, 0)))[:2])[0]
        assert (likelihood > other).all()


def history(spark, series):
    rows = [("X", name, m - len(values), float(v)) for name, values in series.items() for m, v in enumerate(values)]
    return spark.createDataFrame(rows, "country string, brand_name string, months_postgx int, volume double")


def test_forecaster_options_and_short_series(spark):
    t = np.arange(36)
    season = 100 + t + 20 * np.sin(2 * np.pi * t / 12)
    df = history(spark, {"season": season, "short": [5.0, 7.0], "flat": [3.0] * 20, "line": 10.0 + 2 * t})
    plain = fc.SeriesForecaster()
    seasonal = fc.SeriesForecaster((1, 0, 0), (0, 1, 0, 12), "add", "add", 12)
    truth = 100 + np.arange(36, 48) + 20 * np.sin(2 * np.pi * np.arange(36, 48) / 12)

    def of(model, name, **more):
        rows = model.forecast(df, range(12), **more).where(f"brand_name = '{name}'").orderBy("months_postgx").collect()
        return np.array([r["volume"] for r in rows]), rows[0]

    better, row = of(seasonal, "season")
    worse, _ = of(plain, "season")
    assert np.abs(better - truth).max() < 4 < np.abs(worse - truth).max() and row["fitted"] == 1
    assert abs(row["weight_ar"] + row["weight_holt"] - 1) < 1e-9
    assert np.allclose(of(plain, "line")[0], 10 + 2 * np.arange(36, 48), rtol=0.02)
    assert np.allclose(of(plain, "flat")[0], 3.0, atol=1e-3)
    values, row = of(plain, "short")
    assert (values == 7.0).all() and row["fitted"] == 0 and row["log_likelihood"] is None
    base = spark.createDataFrame([("X", "short", 40.0)], "country string, brand_name string, avg_vol double")
    assert np.allclose(of(plain, "short", fallback=base)[0], 40 * np.exp(-0.05 * np.arange(12)))
    with pytest.raises(ValueError):
        fc.Smoothing("up")
