"""Array functions of one window (a column of array<double>), all inside Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}
TOTAL = (0.5, 45.0)
FEATURES = (*BANDS, "spectral_entropy", "hjorth_mobility", "hjorth_complexity", "line_length", "skewness", "kurtosis")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once: inside a lambda Spark would else compute it again for every element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def power_sum(x: Column, centre: Column, power: int) -> Column:
    """Sum of (x - centre)^power."""

    def raised(v: Column) -> Column:
        out = v
        for _ in range(power - 1):
            out = out * v
        return out

    return F.aggregate(x, F.lit(0.0), lambda a, v: a + raised(v - centre))


def variance(x: Column, ddof: int = 0) -> Column:
    return let(mean(x), lambda m: power_sum(x, m, 2)) / (F.size(x) - ddof)


def differences(x: Column) -> Column:
    """x[i + 1] - x[i]; empty for fewer than two values."""
    n = F.size(x)
    return F.when(n > 1, F.zip_with(F.slice(x, 2, F.greatest(n - 1, F.lit(1))), F.slice(x, 1, F.greatest(n - 1, F.lit(1))), lambda a, b: a - b)).otherwise(F.slice(x, 1, 0))


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def all_finite(x: Column) -> Column:
    return F.forall(x, is_finite)


def finite_or_zero(v: Column) -> Column:
    return F.when(is_finite(v), v).otherwise(0.0)


def fit_length(x: Column, length: int) -> Column:
    """Cut or filled up with zeros to `length`."""
    return F.concat(F.slice(x, 1, length), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(length) - F.size(x))))


def fit_shape(signal: Column, channels: int, length: int) -> Column:
    """array<array<double>> cut or filled up with zeros to channels x length."""
    empty = F.array_repeat(F.lit(0.0), length)
    rows = F.transform(F.slice(signal, 1, channels), lambda x: fit_length(x, length))
    return F.concat(rows, F.array_repeat(empty, F.greatest(F.lit(0), F.lit(channels) - F.size(signal))))


def zscore(x: Column, mode: str) -> Column:
    """Five conventions: a ddof 1, / (sd + 1e-6); b ddof 1, / max(sd, 1e-6); c ddof 0, sd < 1e-8 is 1; d ddof 0, sd < 1e-12 gives zeros; e ddof 0, / (sd + 1e-6)."""

    def scaled(b: Column) -> Column:
        sd = b["sd"]
        by = {"a": sd + 1e-6, "b": F.greatest(sd, F.lit(1e-6)), "c": F.when(sd < 1e-8, 1.0).otherwise(sd), "d": F.when(sd >= 1e-12, sd), "e": sd + 1e-6}[mode]
        return let(F.struct(b["m"].alias("m"), by.alias("by")), lambda k: F.transform(x, lambda v: F.coalesce((v - k["m"]) / k["by"], F.lit(0.0)) if mode == "d" else (v - k["m"]) / k["by"]))

    return let(F.struct(mean(x).alias("m"), F.sqrt(variance(x, 1 if mode in "ab" else 0)).alias("sd")), scaled)


def _mobility(x: Column, d: Column) -> Column:
    return let(variance(x), lambda v: F.when((F.size(x) > 1) & (v > 1e-12), F.sqrt(variance(d) / v)).otherwise(0.0))


def mobility(x: Column) -> Column:
    return let(differences(x), lambda d: _mobility(x, d))


def complexity(x: Column) -> Column:
    def of(b: Column) -> Column:
        second = let(differences(b["d"]), lambda e: _mobility(b["d"], e))
        return F.when((F.size(x) > 2) & (b["m"] > 1e-12), second / b["m"]).otherwise(0.0)

    return let(differences(x), lambda d: let(F.struct(d.alias("d"), _mobility(x, d).alias("m")), of))


def line_length(x: Column) -> Column:
    mean_size = lambda d: F.aggregate(d, F.lit(0.0), lambda a, v: a + F.abs(v)) / F.size(d)
    return F.when(F.size(x) > 1, let(differences(x), mean_size)).otherwise(0.0)


def _standard_moment(x: Column, power: int) -> Column:
    """Mean of (x - m)^power over the population deviation to that power; NULL for a constant."""

    def of(m: Column) -> Column:
        n = F.size(x).cast("double")
        return let(power_sum(x, m, 2) / n, lambda m2: F.when(m2 > 1e-24, power_sum(x, m, power) / n / F.pow(m2, power / 2)))

    return let(mean(x), of)


def skewness(x: Column) -> Column:
    """Bias-corrected; NULL where undefined."""
    n = F.size(x).cast("double")
    return F.when(n > 2, _standard_moment(x, 3) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x: Column) -> Column:
    """Excess, bias-corrected; NULL where undefined."""
    n = F.size(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (_standard_moment(x, 4) - 3) + 6))


def _bins(psd: Column, step: Column, low: float, high: float, closed: bool) -> Column:
    """(frequency, power) of the bins in [low, high) or [low, high]."""
    pairs = F.transform(psd, lambda p, i: F.struct((i * step).alias("f"), p.alias("p")))
    return F.filter(pairs, lambda b: (b["f"] >= low) & ((b["f"] <= high) if closed else (b["f"] < high)))


def _trapezoid(bins: Column, step: Column) -> Column:
    def area(b: Column) -> Column:
        inner = F.aggregate(b, F.lit(0.0), lambda a, v: a + v["p"])
        return F.when(F.size(b) > 1, (inner - (F.element_at(b, 1)["p"] + F.element_at(b, -1)["p"]) / 2) * step).otherwise(0.0)

    return let(bins, area)


def band_power(psd: Column, step: Column, band: str) -> Column:
    """Share of a band's power (trapezoid) in that of [0.5, 45] Hz."""
    whole = F.greatest(_trapezoid(_bins(psd, step, *TOTAL, True), step), F.lit(1e-12))
    return _trapezoid(_bins(psd, step, *BANDS[band], False), step) / whole


def spectral_entropy(psd: Column, step: Column) -> Column:
    """Normalised entropy of the bins in [0.5, 45] Hz; 0 without power or with one bin."""

    def of(b: Column) -> Column:
        part = lambda a, v: a - F.greatest(v["p"] / b["s"], F.lit(1e-12)) * F.log(F.greatest(v["p"] / b["s"], F.lit(1e-12)))
        n = F.size(b["bins"])
        return F.when((b["s"] > 1e-12) & (n > 1), F.aggregate(b["bins"], F.lit(0.0), part) / F.log(n.cast("double"))).otherwise(0.0)

    return let(_bins(psd, step, *TOTAL, True), lambda bins: let(F.struct(bins.alias("bins"), F.aggregate(bins, F.lit(0.0), lambda a, v: a + v["p"]).alias("s")), of))


def features(x: Column, psd: Column, step: Column) -> dict[str, Column]:
    """The eleven features of one channel; what is not finite becomes 0."""
    made = {b: band_power(psd, step, b) for b in BANDS}
    made |= {"spectral_entropy": spectral_entropy(psd, step), "hjorth_mobility": mobility(x), "hjorth_complexity": complexity(x), "line_length": line_length(x), "skewness": skewness(x), "kurtosis": kurtosis(x)}
    return {k: let(v, finite_or_zero) for k, v in made.items()}
