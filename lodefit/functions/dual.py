"""Dual numbers: a value together with its derivatives by the parameters.

The value and the derivatives may be columns, arrays or numbers. A model that is
written with operators and the functions of its math namespace is differentiated
by running it on duals; the derivatives are then columns like any other, and one
aggregate sums them beside the values.
"""

from __future__ import annotations

import math
import operator
from typing import Any

import numpy as np
from pyspark.sql import Column

from lodefit.functions.columns import SparkMath


def _plus(a: Any, b: Any) -> Any:
    return b if isinstance(a, float) and a == 0 else a if isinstance(b, float) and b == 0 else a + b


def _times(a: Any, b: Any) -> Any:
    """a * b without the products that change nothing."""
    if isinstance(a, float) and a in (0.0, 1.0):
        return b if a else 0.0
    if isinstance(b, float) and b in (0.0, 1.0):
        return a if b else 0.0
    return a * b


class Dual:
    """value, and slopes: its derivative by each parameter on which it depends, by number."""

    __slots__ = ("slopes", "value")

    def __init__(self, value: Any, slopes: dict[int, Any] | None = None):
        self.value, self.slopes = value, {} if slopes is None else slopes

    def slope(self, j: int) -> Any:
        return self.slopes.get(j, 0.0)

    def chain(self, value: Any, rate: Any) -> Dual:
        """A function of this number: its value, and its derivative by this number."""
        return Dual(value, {j: _times(s, rate) for j, s in self.slopes.items()})

    def _with(self, other: Any, value: Any, own: Any, others: Any) -> Dual:
        other = dual(other)
        return Dual(value, {j: _plus(_times(self.slope(j), own), _times(other.slope(j), others)) for j in {**self.slopes, **other.slopes}})

    def __add__(self, other):
        return self._with(other, self.value + plain(other), 1.0, 1.0)

    def __sub__(self, other):
        return self._with(other, self.value - plain(other), 1.0, -1.0)

    def __mul__(self, other):
        return self._with(other, self.value * plain(other), plain(other), self.value)

    def __truediv__(self, other):
        v = plain(other)
        found = self.value / v
        return self._with(other, found, 1.0 / v, -found / v) if isinstance(other, Dual) and other.slopes else self.chain(found, 1.0 / v)

    def __pow__(self, other):
        e = plain(other)
        if isinstance(other, Dual) and other.slopes:
            raise TypeError("a parameter in an exponent: write exp(log(x) * p)")
        return self.chain(self.value**e, e * self.value ** (e - 1))

    def __radd__(self, other):
        return dual(other) + self

    def __rsub__(self, other):
        return dual(other) - self

    def __rmul__(self, other):
        return dual(other) * self

    def __rtruediv__(self, other):
        return dual(other) / self

    def __neg__(self):
        return self.chain(-self.value, -1.0)

    def __abs__(self):
        return DualMath(_namespace(self.value)).abs(self)

    # conditions look at values alone
    def __lt__(self, other):
        return self.value < plain(other)

    def __le__(self, other):
        return self.value <= plain(other)

    def __gt__(self, other):
        return self.value > plain(other)

    def __ge__(self, other):
        return self.value >= plain(other)

    def __array_ufunc__(self, ufunc, method, *inputs, **options):
        """NumPy's functions and operators, where a dual is among what they are given."""
        name = ufunc.__name__
        if method != "__call__" or options or name not in _UFUNCS:
            return NotImplemented
        return getattr(DualMath(np), _UFUNCS[name])(*inputs) if len(inputs) == 1 else _UFUNCS[name](dual(inputs[0]), inputs[1])

    def log(self):
        return DualMath(_namespace(self.value)).log(self)


_UFUNCS = {name: name for name in ("exp", "log", "sqrt", "sin", "cos", "arctan")} | {
    "absolute": "abs", "add": operator.add, "subtract": operator.sub, "multiply": operator.mul, "divide": operator.truediv, "power": operator.pow,
    "greater": operator.gt, "greater_equal": operator.ge, "less": operator.lt, "less_equal": operator.le,
}


def dual(x: Any) -> Dual:
    return x if isinstance(x, Dual) else Dual(x)


def plain(x: Any) -> Any:
    return x.value if isinstance(x, Dual) else x


def _namespace(value: Any) -> Any:
    return SparkMath if isinstance(value, Column) else np


class DualMath:
    """The functions that a model may use, on duals over a math namespace (SparkMath or NumPy)."""

    pi = math.pi

    def __init__(self, base: Any):
        self.base = base

    def exp(self, x):
        v = self.base.exp(plain(x))
        return dual(x).chain(v, v)

    def log(self, x):
        return dual(x).chain(self.base.log(plain(x)), 1.0 / plain(x))

    def sqrt(self, x):
        v = self.base.sqrt(plain(x))
        return dual(x).chain(v, 0.5 / v)

    def sin(self, x):
        return dual(x).chain(self.base.sin(plain(x)), self.base.cos(plain(x)))

    def cos(self, x):
        return dual(x).chain(self.base.cos(plain(x)), -self.base.sin(plain(x)))

    def arctan(self, x):
        v = plain(x)
        return dual(x).chain(self.base.arctan(v), 1.0 / (1.0 + v * v))

    def abs(self, x):
        v = plain(x)
        return dual(x).chain(self.base.abs(v), self.base.where(v >= 0, 1.0, -1.0))

    def maximum(self, a, b):
        return self._choose(plain(a) >= plain(b), a, b, self.base.maximum(plain(a), plain(b)))

    def minimum(self, a, b):
        return self._choose(plain(a) <= plain(b), a, b, self.base.minimum(plain(a), plain(b)))

    def where(self, condition, a, b):
        return self._choose(condition, a, b, self.base.where(condition, plain(a), plain(b)))

    def _choose(self, first, a, b, value):
        a, b = dual(a), dual(b)
        return Dual(value, {j: self.base.where(first, a.slope(j), b.slope(j)) for j in {**a.slopes, **b.slopes}})
