"""Column helpers: a math namespace that models share with NumPy, stable rounding and hashed randomness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 2.2250738585072014e-308


class SparkMath:
    """The functions a model may use, on columns; NumPy has the same names."""

    pi = 3.141592653589793
    exp = staticmethod(lambda x: F.exp(x))
    log = staticmethod(lambda x: F.ln(x))
    sqrt = staticmethod(lambda x: F.sqrt(x))
    sin = staticmethod(lambda x: F.sin(x))
    cos = staticmethod(lambda x: F.cos(x))
    arctan = staticmethod(lambda x: F.atan(x))
    abs = staticmethod(lambda x: F.abs(x))
    maximum = staticmethod(lambda a, b: F.greatest(_column(a), _column(b)))
    minimum = staticmethod(lambda a, b: F.least(_column(a), _column(b)))
    where = staticmethod(lambda c, a, b: F.when(c, a).otherwise(b))


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def sig(c: Column, digits: int = 9) -> Column:
    """A double rounded to significant digits, so that sums of any order agree."""
    return F.format_string(f"%.{digits - 1}e", c.cast("double") + F.lit(0.0)).cast("double")


def sig_sql(expression: str, digits: int = 9) -> str:
    """The same in DuckDB."""
    return f"CAST(printf('%.{digits - 1}e', CAST(({expression}) AS DOUBLE) + 0.0) AS DOUBLE)"


def uniform(*keys: Column) -> Column:
    """A uniform number in [0, 1) that depends on the keys alone: the first 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("double") / 4294967296.0


def uniform_sql(*keys: str) -> str:
    return "CAST(('0x' || substr(md5(" + " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) + "), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"


def normal(*keys: Column) -> Column:
    """A standard normal number from two hashed uniforms."""
    a, b = uniform(*keys, F.lit("a")), uniform(*keys, F.lit("b"))
    return F.sqrt(-2 * F.ln(1 - a)) * F.cos(2 * SparkMath.pi * b)


def poisson_steps(x: Column, most: int = 10) -> Column:
    """A Poisson number of mean 1 from a uniform one that is at hand: x is read once for each step."""
    total, term, steps = 0.0, 0.36787944117144233, []
    for k in range(1, most + 1):
        total += term
        steps.append(total)
        term /= k
    return sum((F.when(x >= t, 1).otherwise(0) for t in steps), F.lit(0))


def poisson1(u: Column, most: int = 10) -> Column:
    """The same from any expression; weights of a bootstrap replicate."""
    # u is bound once: a hash in it isn't computed anew for each step
    return F.transform(F.array(u), lambda x: poisson_steps(x, most))[0]


def poisson1_sql(u: str, most: int = 10) -> str:
    total, term, parts = 0.0, 0.36787944117144233, []
    for k in range(1, most + 1):
        total += term
        parts.append(f"(CASE WHEN {u} >= {total!r}::DOUBLE THEN 1 ELSE 0 END)")
        term /= k
    return " + ".join(parts)
