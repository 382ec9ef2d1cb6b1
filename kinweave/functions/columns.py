"""Column functions: vectors, hash uniforms, joined names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-16
NAN = float("nan")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; NaN if either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(NAN)).otherwise(dot(a, b) / norms)


def unit(a: Column) -> Column:
    """The vector at length 1 in double precision; of NaN if it is zero."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm == 0, F.lit(NAN)).otherwise(x.cast("double") / norm))


def uniform(seed: int | str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone, from 52 bits of an MD5.

    The same on every engine and under any partitioning, so draws survive a lost executor.
    """
    return uniform_of(F.lit(str(seed)), *keys)


def uniform_of(*keys: Column) -> Column:
    """As `uniform`, with a seed that may be a column."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def three_uniforms(digest: Column) -> list[Column]:
    """Three numbers in [0, 1) from an MD5 as hex text: of 52, 52 and 24 bits."""
    cuts = ((1, 13), (14, 13), (27, 6))
    return [F.conv(F.substring(digest, at, n), 16, 10).cast("double") / F.lit(float(16**n)) for at, n in cuts]


def padded(prefix: str, number: Column) -> Column:
    """``prefix`` with a number of at least four digits."""
    return F.format_string(f"{prefix}%04d", number)


def log_stats(value: str, name: str) -> list[Column]:
    """Geometric mean and 95 % interval of a group's ``value`` column, clamped to [0, 1]: avg_<name>, <name>_ci_lower, <name>_ci_upper.

    One value has the interval (1e-16, 1e-16).
    """
    logs = F.log(F.col(value) + EPS)
    mean = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(F.avg(logs)) - EPS))
    n = F.count(F.col(value))
    step = F.exp(F.coalesce(F.stddev_samp(logs), F.lit(0.0)) * 1.96 / F.sqrt(n))

    def bound(x: Column) -> Column:
        return F.when(n <= 1, F.lit(EPS)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))

    return [mean.alias(f"avg_{name}"), bound(mean / step).alias(f"{name}_ci_lower"), bound(mean * step).alias(f"{name}_ci_upper")]
