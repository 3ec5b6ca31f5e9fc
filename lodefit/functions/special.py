"""Chi-square probabilities from the incomplete gamma function."""

from __future__ import annotations

import math


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function P(a, x)."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))
    return 1 - gamma_q(a, x)


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function Q(a, x), by its continued fraction for large x."""
    if x < a + 1:
        return 1 - gamma_p(a, x)
    small = 1e-300
    b = x + 1 - a
    c, d = 1 / small, 1 / b
    h = d
    for i in range(1, 10_000):
        an = i * (a - i)
        b += 2
        d = 1 / (d * an + b or small)
        c = b + an / c or small
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return math.exp(a * math.log(x) - x - math.lgamma(a)) * h


def chisq_cl(delta: float, ndof: int) -> float:
    """The probability that a chi-square of ndof degrees of freedom is at most delta."""
    if ndof < 1:
        raise ValueError("ndof must be at least 1")
    return gamma_p(ndof / 2, delta / 2)


def p_value(chi2: float, ndf: int) -> float:
    """The probability of a chi-square at least this large."""
    return gamma_q(ndf / 2, chi2 / 2) if ndf > 0 else math.nan


def probability(cl: float) -> float:
    """cl below 1 is a probability; 1 or more is a number of standard deviations."""
    if not cl > 0:
        raise ValueError("a confidence level must be positive")
    return cl if cl < 1 else math.erf(cl / math.sqrt(2))


def delta_chisq(cl: float, ndof: int = 1) -> float:
    """The chi-square quantile of a confidence level, by bisection and Newton steps."""
    if ndof == 1 and cl >= 1:
        return cl * cl
    p = probability(cl)
    lo, hi = 0.0, 1.0
    while chisq_cl(hi, ndof) < p and hi < 1e6:
        hi *= 2
    x = (lo + hi) / 2
    for _ in range(200):
        f = chisq_cl(x, ndof) - p
        lo, hi = (x, hi) if f < 0 else (lo, x)
        density = math.exp((ndof / 2 - 1) * math.log(x) - x / 2 - math.lgamma(ndof / 2) - ndof / 2 * math.log(2)) if x > 0 else 0
        step = x - f / density if density else math.nan
        new = step if lo < step < hi else (lo + hi) / 2
        if abs(new - x) <= 1e-15 * max(1.0, abs(x)):
            break
        x = new
    return x
