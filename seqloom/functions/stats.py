"""Special functions and tests for numbers on the driver: small aggregates come in, a few numbers go out."""

from __future__ import annotations

import math

import numpy as np


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, tiny = 1.0, 1 - (a + b) * x / (a + 1), 1e-300
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def incomplete_gamma(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def binomial_pmf(k: int, n: int, p: float) -> float:
    if p <= 0 or p >= 1:
        return float(k == (0 if p <= 0 else n))
    return math.exp(log_choose(n, k) + k * math.log(p) + (n - k) * math.log1p(-p))


def binomial_tail(k: int, n: int, p: float) -> float:
    """Probability of k successes or more."""
    return 1.0 if k <= 0 else 0.0 if k > n else incomplete_beta(k, n - k + 1, p)


def binomial_inverse(k: int, n: int, tail: float) -> float:
    """The success probability at which k or more have the given probability, by bisection."""
    low, high = 0.0, 1.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if binomial_tail(k, n, middle) < tail else (low, middle)
    return (low + high) / 2


def hypergeometric_cdf(k: int, total: int, good: int, drawn: int) -> float:
    """Probability of k or fewer good ones among those drawn."""
    least = max(0, drawn - (total - good))
    terms = [log_choose(good, i) + log_choose(total - good, drawn - i) - log_choose(total, drawn) for i in range(least, min(k, good, drawn) + 1)]
    return min(1.0, float(np.exp(terms).sum())) if terms else 0.0


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_inverse(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if normal_cdf(middle) < p else (low, middle)
    return (low + high) / 2


def chi_square_tail(x: float, freedom: int) -> float:
    return 1 - incomplete_gamma(freedom / 2, x / 2)


def z_score(hits: float, n: float, p: float) -> float:
    return (hits - n * p) / math.sqrt(n * p * (1 - p)) if n > 0 and 0 < p < 1 else 0.0


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def inverse_logit(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def fit_decay(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float, float]:
    """a, b, c of y = a exp(-b x) + c, by damped least squares."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    span = max(float(x.max() - x.min()), 1e-9)
    theta, damp = np.array([float(y[0] - y[-1]), 3 / span, float(y[-1])]), 1e-3
    value = lambda t: t[0] * np.exp(np.clip(-t[1] * x, -700, 700)) + t[2]
    cost = float(((y - value(theta)) ** 2).sum())
    for _ in range(rounds):
        e = np.exp(np.clip(-theta[1] * x, -700, 700))
        jacobian = np.stack([e, -theta[0] * x * e, np.ones_like(x)], axis=1)
        normal = jacobian.T @ jacobian
        step = np.linalg.solve(normal + damp * np.diag(np.diag(normal) + 1e-12), jacobian.T @ (y - value(theta)))
        tried = theta + step
        now = float(((y - value(tried)) ** 2).sum())
        if now < cost:
            done = cost - now < 1e-14 * max(cost, 1e-300)
            theta, cost, damp = tried, now, max(damp / 10, 1e-12)
            if done:
                break
        else:
            damp = min(damp * 10, 1e12)
    return float(theta[0]), float(theta[1]), float(theta[2])
