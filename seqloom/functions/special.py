"""Special functions as columns, in built-in operators only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(x) -> Column:
    """ln of the gamma function of a positive number: Stirling's series behind eight steps of the recurrence."""
    x = F.col(x) if isinstance(x, str) else x
    y = x + 8
    tail = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - F.log(product)


def log_choose(n, k) -> Column:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def negative_binomial(k, size: float, p: float) -> Column:
    """ln of the probability of k failures before ``size`` successes."""
    k = F.col(k) if isinstance(k, str) else k
    return log_gamma(k + size) - log_gamma(k + 1) - math.lgamma(size) + size * math.log(p) + k * math.log1p(-p)


def inverse_logit(x) -> Column:
    return 1 / (1 + F.exp(-x))
