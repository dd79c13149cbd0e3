"""Quantiles of the normal and Student's t distributions, for forecast ranges."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(96)
_KNOWN: dict[tuple[float, float], float] = {}


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def student_t_cdf(t: float, freedom: float) -> float:
    """With t = sqrt(freedom) * tan(angle) the density is a power of the cosine, integrated by Gauss-Legendre."""
    angle = math.atan(abs(t) / math.sqrt(freedom))
    scale = math.exp(math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2)) / math.sqrt(math.pi)
    area = float(np.sum(_WEIGHTS * np.cos((_NODES + 1) * angle / 2) ** (freedom - 1))) * angle / 2 * scale
    return 0.5 + math.copysign(area, t)


def student_t_quantile(p: float, freedom: float) -> float:
    if p < 0.5:
        return -student_t_quantile(1 - p, freedom)
    if (p, freedom) in _KNOWN:
        return _KNOWN[p, freedom]
    lo, hi = 0.0, 2.0
    while student_t_cdf(hi, freedom) < p:
        lo, hi = hi, hi * 2
    for _ in range(200):
        middle = (lo + hi) / 2
        if middle in (lo, hi):
            break
        lo, hi = (middle, hi) if student_t_cdf(middle, freedom) < p else (lo, middle)
    _KNOWN[p, freedom] = (lo + hi) / 2
    return _KNOWN[p, freedom]
