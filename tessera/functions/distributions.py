"""Probability distributions as builders of column expressions (inventory C313-C324, O1)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import special


class Distribution:
    """A plug-in: density, distribution function, quantile and moments."""

    def pdf(self, x: Column) -> Column:
        raise NotImplementedError

    def cdf(self, x: Column) -> Column:
        raise NotImplementedError

    def quantile(self, u: Column) -> Column:
        """The value below which the share ``u`` lies; turns uniform numbers into samples."""
        raise NotImplementedError

    mean: float | None
    variance: float | None


@dataclass(frozen=True)
class Normal(Distribution):
    mu: float = 0.0
    sigma: float = 1.0

    def pdf(self, x):
        z = (x - self.mu) / self.sigma
        return F.exp(-z * z / 2) / (self.sigma * math.sqrt(2 * math.pi))

    def cdf(self, x):
        return special.normal_cdf_fine((x - self.mu) / self.sigma)

    def quantile(self, u):
        return self.mu + self.sigma * special.normal_inv_cdf(u)

    mean = property(lambda self: self.mu)
    variance = property(lambda self: self.sigma**2)


@dataclass(frozen=True)
class Uniform(Distribution):
    low: float = 0.0
    high: float = 1.0

    def pdf(self, x):
        return F.when((x >= self.low) & (x <= self.high), 1 / (self.high - self.low)).otherwise(0.0)

    def cdf(self, x):
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - self.low) / (self.high - self.low)))

    def quantile(self, u):
        return self.low + (self.high - self.low) * u

    mean = property(lambda self: (self.low + self.high) / 2)
    variance = property(lambda self: (self.high - self.low) ** 2 / 12)


@dataclass(frozen=True)
class Laplace(Distribution):
    mu: float = 0.0
    scale: float = 1.0

    def pdf(self, x):
        return F.exp(-F.abs(x - self.mu) / self.scale) / (2 * self.scale)

    def cdf(self, x):
        side = 0.5 * F.exp(-F.abs(x - self.mu) / self.scale)
        return F.when(x < self.mu, side).otherwise(1 - side)

    def quantile(self, u):
        return self.mu - self.scale * F.signum(u - 0.5) * F.log(1 - 2 * F.abs(u - 0.5))

    mean = property(lambda self: self.mu)
    variance = property(lambda self: 2 * self.scale**2)


@dataclass(frozen=True)
class LogNormal(Distribution):
    mu: float = 0.0
    sigma: float = 1.0

    def pdf(self, x):
        z = (F.log(x) - self.mu) / self.sigma
        return F.when(x <= 0, 0.0).otherwise(F.exp(-z * z / 2) / (x * self.sigma * math.sqrt(2 * math.pi)))

    def cdf(self, x):
        return F.when(x <= 0, 0.0).otherwise(special.normal_cdf_fine((F.log(x) - self.mu) / self.sigma))

    def quantile(self, u):
        return F.exp(self.mu + self.sigma * special.normal_inv_cdf(u))

    mean = property(lambda self: math.exp(self.mu + self.sigma**2 / 2))
    variance = property(lambda self: (math.exp(self.sigma**2) - 1) * math.exp(2 * self.mu + self.sigma**2))


@dataclass(frozen=True)
class Weibull(Distribution):
    scale: float = 1.0
    shape: float = 1.0

    def pdf(self, x):
        r = x / self.scale
        return F.when(x < 0, 0.0).otherwise(self.shape / self.scale * F.pow(r, self.shape - 1) * F.exp(-F.pow(r, F.lit(self.shape))))

    def cdf(self, x):
        return F.when(x <= 0, 0.0).otherwise(1 - F.exp(-F.pow(x / self.scale, F.lit(self.shape))))

    def quantile(self, u):
        return self.scale * F.pow(-F.log(1 - u), F.lit(1 / self.shape))

    mean = property(lambda self: self.scale * math.gamma(1 + 1 / self.shape))
    variance = property(lambda self: self.scale**2 * (math.gamma(1 + 2 / self.shape) - math.gamma(1 + 1 / self.shape) ** 2))


@dataclass(frozen=True)
class Pareto(Distribution):
    least: float = 1.0
    alpha: float = 1.0

    def pdf(self, x):
        return F.when(x < self.least, 0.0).otherwise(self.alpha * self.least**self.alpha / F.pow(x, F.lit(self.alpha + 1)))

    def cdf(self, x):
        return F.when(x < self.least, 0.0).otherwise(1 - F.pow(self.least / x, F.lit(self.alpha)))

    def quantile(self, u):
        return self.least / F.pow(1 - u, F.lit(1 / self.alpha))

    mean = property(lambda self: self.alpha * self.least / (self.alpha - 1) if self.alpha > 1 else None)
    variance = property(
        lambda self: self.least**2 * self.alpha / ((self.alpha - 1) ** 2 * (self.alpha - 2)) if self.alpha > 2 else None
    )


@dataclass(frozen=True)
class StudentT(Distribution):
    df: float = 5.0
    location: float = 0.0
    scale: float = 1.0

    def pdf(self, x):
        z = (x - self.location) / self.scale
        front = math.exp(math.lgamma((self.df + 1) / 2) - math.lgamma(self.df / 2)) / (math.sqrt(self.df * math.pi) * self.scale)
        return front * F.pow(1 + z * z / self.df, F.lit(-(self.df + 1) / 2))

    def cdf(self, x):
        return special.student_t_cdf((x - self.location) / self.scale, F.lit(self.df))

    mean = property(lambda self: self.location if self.df > 1 else None)
    variance = property(lambda self: self.scale**2 * self.df / (self.df - 2) if self.df > 2 else None)


@dataclass(frozen=True)
class Mixture(Distribution):
    parts: tuple[tuple[float, Distribution], ...]

    def __post_init__(self):
        weights = [w for w, _ in self.parts]
        if any(not 0 <= w <= 1 for w in weights) or abs(sum(weights) - 1) > 1e-9:
            raise ValueError("weights must lie in [0, 1] and add up to 1")

    def pdf(self, x):
        return sum((w * d.pdf(x) for w, d in self.parts), F.lit(0.0))

    def cdf(self, x):
        return sum((w * d.cdf(x) for w, d in self.parts), F.lit(0.0))

    def component(self, u: Column) -> Column:
        """Index of the part that a uniform number picks."""
        total, out = 0.0, None
        for i, (w, _) in enumerate(self.parts[:-1]):
            total += w
            out = F.when(u < total, i) if out is None else out.when(u < total, i)
        last = len(self.parts) - 1
        return F.lit(last) if out is None else out.otherwise(last)

    @property
    def mean(self):
        means = [d.mean for _, d in self.parts]
        return None if None in means else sum(w * m for (w, _), m in zip(self.parts, means))

    @property
    def variance(self):
        """Law of total variance."""
        mean, variances = self.mean, [d.variance for _, d in self.parts]
        if mean is None or None in variances:
            return None
        return sum(w * (v + (d.mean - mean) ** 2) for (w, d), v in zip(self.parts, variances))


def from_config(kind: str, p1: float, p2: float, parts: list[tuple[float, Distribution]] | None = None) -> Distribution:
    """A distribution from its kind and two parameters."""
    kinds = {"normal": Normal, "uniform": Uniform, "laplace": Laplace, "lognormal": LogNormal, "weibull": Weibull, "pareto": Pareto}
    if kind == "mixture":
        return Mixture(tuple(parts or ()))
    if kind == "student_t":
        return StudentT(p1, p2)
    return kinds[kind](p1, p2)


def from_family(family: str, mean: float, std: float) -> Distribution:
    """A distribution of a family with this mean and deviation (Weibull and Pareto are only scaled)."""
    if family == "normal":
        return Normal(mean, std)
    if family == "uniform":
        return Uniform(mean - math.sqrt(3) * std, mean + math.sqrt(3) * std)
    if family == "laplace":
        return Laplace(mean, std / math.sqrt(2))
    if family == "student_t":
        return StudentT(5.0, mean, std / math.sqrt(5 / 3))
    if family == "lognormal":
        spread = math.log(1 + (std / mean) ** 2)
        return LogNormal(math.log(mean) - spread / 2, math.sqrt(spread))
    if family == "weibull":
        return Weibull(std, 2.0)
    if family == "pareto":
        return Pareto(std, 3.0)
    if family == "mixture":
        return Mixture(((0.9, Normal(mean, 0.5 * std)), (0.1, Normal(mean, std * math.sqrt((1 - 0.9 * 0.25) / 0.1)))))
    raise ValueError(f"unknown family {family}")
