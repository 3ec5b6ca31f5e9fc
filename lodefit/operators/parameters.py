"""Parameters with limits, and the coordinates without limits that minimizers move in."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np


@dataclass(frozen=True)
class MachinePrecision:
    """eps: the relative noise of the objective. Sums over many partitions need a larger one."""

    eps: float = 8.8e-16

    @property
    def eps2(self) -> float:
        return 2 * math.sqrt(self.eps)


@dataclass(frozen=True)
class Strategy:
    """How much is spent on derivatives: 0 is quick, 1 the default, 2 thorough.

    The fixed values of the three levels, in order: gradient cycles, step and
    gradient tolerance; Hessian cycles, step and curvature tolerance; gradient
    cycles within the Hessian.
    """

    level: int = 1

    # fixed values
    _VALUES = ((2, 0.5, 0.1, 3, 0.5, 0.1, 1), (3, 0.3, 0.05, 5, 0.3, 0.05, 2), (5, 0.1, 0.02, 7, 0.1, 0.02, 6))

    def __post_init__(self):
        if self.level not in (0, 1, 2):
            raise ValueError("a strategy is 0, 1 or 2")

    gradient_cycles = property(lambda self: self._VALUES[self.level][0])
    step_tolerance = property(lambda self: self._VALUES[self.level][1])
    gradient_tolerance = property(lambda self: self._VALUES[self.level][2])
    hessian_cycles = property(lambda self: self._VALUES[self.level][3])
    hessian_step_tolerance = property(lambda self: self._VALUES[self.level][4])
    curvature_tolerance = property(lambda self: self._VALUES[self.level][5])
    hessian_gradient_cycles = property(lambda self: self._VALUES[self.level][6])


@dataclass(frozen=True)
class Parameter:
    """A named parameter; lower and upper are None where there is no limit."""

    name: str
    value: float
    error: float = 0.1
    lower: float | None = None
    upper: float | None = None
    fixed: bool = False

    def __post_init__(self):
        for k in ("lower", "upper"):
            v = getattr(self, k)
            if v is not None and not math.isfinite(v):
                object.__setattr__(self, k, None)
        if self.lower is not None and self.upper is not None and not self.lower < self.upper:
            raise ValueError(f"{self.name}: the lower limit must be below the upper")

    has_lower_limit = property(lambda self: self.lower is not None)
    has_upper_limit = property(lambda self: self.upper is not None)
    has_limits = property(lambda self: self.lower is not None or self.upper is not None)
    is_fixed = property(lambda self: self.fixed)

    @property
    def bound_kind(self) -> str:
        return {(False, False): "none", (True, False): "lower", (False, True): "upper", (True, True): "both"}[self.has_lower_limit, self.has_upper_limit]

    def inside(self, x: float) -> bool:
        return (self.lower is None or x >= self.lower) and (self.upper is None or x <= self.upper)

    # a sine maps a line to a closed interval, a root of a square to a half line
    def to_external(self, v):
        if self.bound_kind == "both":
            return self.lower + (self.upper - self.lower) * (np.sin(v) + 1) / 2
        if self.bound_kind == "upper":
            return self.upper + 1 - np.sqrt(v * v + 1)
        if self.bound_kind == "lower":
            return self.lower - 1 + np.sqrt(v * v + 1)
        return v

    def to_internal(self, x: float, precision: MachinePrecision = MachinePrecision()) -> float:
        if self.bound_kind == "both":
            y = 2 * (x - self.lower) / (self.upper - self.lower) - 1
            edge = math.pi / 2 - 8 * math.sqrt(precision.eps2)
            return math.asin(y) if abs(y) < 1 and abs(math.asin(y)) < edge else math.copysign(edge, y)
        if self.bound_kind == "upper":
            return math.sqrt(max(0.0, (self.upper - x + 1) ** 2 - 1))
        if self.bound_kind == "lower":
            return math.sqrt(max(0.0, (x - self.lower + 1) ** 2 - 1))
        return x

    def slope(self, v: float) -> float:
        """The derivative of the external value by the internal one."""
        if self.bound_kind == "both":
            return (self.upper - self.lower) * math.cos(v) / 2
        if self.bound_kind == "upper":
            return -v / math.sqrt(v * v + 1)
        if self.bound_kind == "lower":
            return v / math.sqrt(v * v + 1)
        return 1.0

    def external_error(self, v: float, error: float) -> float:
        """The mean shift of the external value for an internal error either way; the whole range for a large one."""
        if self.bound_kind == "none":
            return error
        if self.bound_kind == "both" and error > 1:
            return self.upper - self.lower
        x = self.to_external(v)
        return (abs(self.to_external(v + error) - x) + abs(self.to_external(v - error) - x)) / 2


@dataclass(frozen=True)
class Parameters:
    """An ordered list of parameters with unique names. Changes make a new list."""

    items: tuple[Parameter, ...] = field(default_factory=tuple)

    def __post_init__(self):
        object.__setattr__(self, "items", tuple(self.items))
        if len({p.name for p in self.items}) != len(self.items):
            raise ValueError("parameter names must be unique")

    def __iter__(self):
        return iter(self.items)

    def __len__(self):
        return len(self.items)

    def index(self, key: str | int) -> int:
        return key if isinstance(key, int) else [p.name for p in self.items].index(key)

    def __getitem__(self, key: str | int) -> Parameter:
        return self.items[self.index(key)]

    def set(self, key: str | int, **changes) -> Parameters:
        at = self.index(key)
        return Parameters(tuple(replace(p, **changes) if i == at else p for i, p in enumerate(self.items)))

    names = property(lambda self: tuple(p.name for p in self.items))
    n_pars = property(lambda self: len(self.items))
    free = property(lambda self: [i for i, p in enumerate(self.items) if not p.fixed])
    n_free = property(lambda self: len(self.free))

    def ext_index(self, internal: int) -> int:
        return self.free[internal]

    def int_index(self, external: int) -> int:
        return self.free.index(external)

    def values(self) -> np.ndarray:
        return np.array([p.value for p in self.items], float)

    def initial_internal(self, precision: MachinePrecision = MachinePrecision()) -> np.ndarray:
        return np.array([self.items[i].to_internal(self.items[i].value, precision) for i in self.free])

    def initial_internal_errors(self, precision: MachinePrecision = MachinePrecision()) -> np.ndarray:
        """The mean internal shift for the external step either way, kept within the limits."""
        out = []
        for i in self.free:
            p = self.items[i]
            v = p.to_internal(p.value, precision)
            ends = [x if p.upper is None else min(x, p.upper) for x in (p.value + p.error, p.value - p.error)]
            ends = [x if p.lower is None else max(x, p.lower) for x in ends]
            shift = sum(abs(p.to_internal(x, precision) - v) for x in ends) / 2
            out.append(shift if shift > 0 else 0.1)
        return np.array(out)

    def external(self, internal: np.ndarray) -> np.ndarray:
        """Rows of all external values for rows of free internal ones."""
        internal = np.atleast_2d(internal)
        out = np.tile(self.values(), (len(internal), 1))
        for k, i in enumerate(self.free):
            out[:, i] = self.items[i].to_external(internal[:, k])
        return out

    def internal(self, external) -> np.ndarray:
        return np.array([self.items[i].to_internal(float(external[i])) for i in self.free])

    def slopes(self, internal: np.ndarray) -> np.ndarray:
        return np.array([self.items[i].slope(v) for i, v in zip(self.free, internal, strict=True)])
