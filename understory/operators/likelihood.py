"""Row densities of the mixed models and their derivatives by the linear predictor, on arrays.

Each function gives, per row: l log-density, g its slope, we expected and w observed information, t the slope of w, and by
the log precision: lk slope of l, gk of g, wk of w (zero where there is no precision).
"""

from __future__ import annotations

import numpy as np

_SHIFT = 8  # recurrences lift the argument by this much, where the asymptotic series hold


def log_gamma(x):
    z = x + _SHIFT
    i = 1.0 / z
    i2 = i * i
    series = i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 * (1 / 1680 - i2 / 1188))))
    lifted = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series
    return lifted - np.log(np.prod([x + k for k in range(_SHIFT)], axis=0))


def polygammas(x):
    """First three derivatives of log_gamma."""
    z = x + _SHIFT
    i = 1.0 / z
    i2 = i * i
    first = np.log(z) - i / 2 - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 * (1 / 240 - i2 / 132))))
    second = i + i2 / 2 + i * i2 * (1 / 6 - i2 * (1 / 30 - i2 * (1 / 42 - i2 * (1 / 30 - i2 * 5 / 66))))
    third = -i2 - i * i2 - i2 * i2 * (1 / 2 - i2 * (1 / 6 - i2 * (1 / 6 - i2 * (3 / 10 - i2 * 5 / 6))))
    for k in range(_SHIFT):
        y = 1.0 / (x + k)
        first, second, third = first - y, second + y * y, third - 2 * y * y * y
    return first, second, third


def bernoulli_rows(y, eta):
    mu = 1.0 / (1.0 + np.exp(-eta))
    w = mu * (1 - mu)
    none = np.zeros_like(w)
    return {"l": y * eta - np.maximum(eta, 0) - np.log1p(np.exp(-np.abs(eta))), "g": y - mu, "we": w, "w": w, "t": w * (1 - 2 * mu),
            "lk": none, "gk": none, "wk": none}


def beta_rows(y, eta, phi: float):
    mu = np.clip(1.0 / (1.0 + np.exp(-eta)), 1e-9, 1 - 1e-9)
    a, b = mu * phi, (1 - mu) * phi
    (a1, a2, a3), (b1, b2, b3) = polygammas(a), polygammas(b)
    v, q = mu * (1 - mu), 1 - 2 * mu
    log_y, log_1y = np.log(y), np.log1p(-y)
    dev, tri, mix = log_y - log_1y - (a1 - b1), a2 + b2, mu * a2 - (1 - mu) * b2
    we = phi**2 * v**2 * tri
    return {"l": log_gamma(phi) - log_gamma(a) - log_gamma(b) + (a - 1) * log_y + (b - 1) * log_1y,
            "g": phi * v * dev, "we": we, "w": we - phi * v * q * dev,
            "t": 3 * q * we + phi**3 * v**3 * (a3 - b3) - phi * v * (q**2 - 2 * v) * dev,
            "lk": phi * (polygammas(np.asarray(phi))[0] - mu * a1 - (1 - mu) * b1 + mu * log_y + (1 - mu) * log_1y),
            "gk": phi * v * dev - phi**2 * v * mix,
            "wk": 2 * we + phi**3 * v**2 * (mu * a3 + (1 - mu) * b3) - phi * v * q * dev + phi**2 * v * q * mix}
