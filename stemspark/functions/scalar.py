"""Column functions: complex numbers in two columns, intensity scales, rounding, vectors, weights, headers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def complex_abs(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def complex_phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def complex_real(re: Column, im: Column) -> Column:
    """The real part, as a view of its own beside amplitude and phase."""
    return re + 0.0


def complex_mul_conj(a_re: Column, a_im: Column, b_re: Column, b_im: Column) -> tuple[Column, Column]:
    """a times the conjugate of b."""
    return a_re * b_re + a_im * b_im, a_im * b_re - a_re * b_im


def log_scale(v: Column, kind: str) -> Column:
    """Five scales: log10_floor, log10_offset, ln_offset, log1p, signed_log10."""
    if kind == "log10_floor":
        return F.log10(F.greatest(v, F.lit(1e-10)))
    if kind == "log10_offset":
        return F.log10(v + 1e-10)
    if kind == "ln_offset":
        return F.log(v + 1e-10)
    if kind == "log1p":
        return F.log1p(v)
    if kind == "signed_log10":
        return F.signum(v) * F.log10(F.abs(v) + 1e-10)
    raise ValueError(f"no scale is called {kind}")


def gamma_normalize(v: Column, low: Column, high: Column, gamma: float = 0.8) -> Column:
    """v between low and high as 0 to 1, to the power gamma; 0 where low equals high."""
    return F.when(high > low, F.pow((v - low) / (high - low), F.lit(gamma))).otherwise(F.lit(0.0))


def clip(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def round_half_even(v: Column) -> Column:
    return F.rint(v)


def magnitude(dy: Column, dx: Column) -> Column:
    return F.hypot(dy, dx)


def angle_degrees(dy: Column, dx: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def magnitude_clip(dy: Column, dx: Column, most: float) -> tuple[Column, Column]:
    """A vector no longer than `most`, its direction kept."""
    scale = F.when(magnitude(dy, dx) > most, most / magnitude(dy, dx)).otherwise(F.lit(1.0))
    return dy * scale, dx * scale


def header_field(header: Column, k: int) -> Column:
    """Field k (from 0) of a comma-separated header, trimmed; null beyond its end."""
    return F.trim(F.get(F.split(header, ","), k))


def attr_json(raw: Column) -> Column:
    """An attribute in JSON's normal form if it is JSON, else as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(raw)), raw)


STAMP = "yyyyMMdd_HHmmss"


def run_name(dataset_id: Column, ts: Column) -> Column:
    return F.concat(dataset_id.cast("string"), F.lit("_superres_"), F.date_format(ts, STAMP))


def run_timestamp(name: Column) -> Column:
    """The time in a run's name, null if it has none."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"(\d{8}_\d{6})$", 1), F.lit("")), F.lit(STAMP))


def hann_weight(u: Column, n: int) -> Column:
    """Symmetric Hann window of n places; 1 for a single place."""
    return F.lit(1.0) if n == 1 else 0.5 - 0.5 * F.cos(2 * math.pi * u / (n - 1))


def gauss_weight(u: Column, n: int, share: float = 0.3) -> Column:
    """Gaussian about the middle of n places, sigma a share of n."""
    return F.exp(-F.pow(u - (n - 1) / 2, F.lit(2)) / (2 * (share * n) ** 2))


def radial_gauss_weight(du: Column, dv: Column, n_u: int, n_v: int) -> Column:
    """exp(-r^2 / (2 s)) of offsets from the centre, s = 2 (max(n_u, n_v) / 2)^2."""
    return F.exp(-(du * du + dv * dv) / (2 * 2 * (max(n_u, n_v) / 2) ** 2))


def poly_terms(u: Column, v: Column, order: int, intercept: bool = True) -> list[Column]:
    """Monomials u^a v^b of total degree 1 to order (the constant first if wanted), by degree, then falling a."""
    out = [F.lit(1.0)] if intercept else []
    for degree in range(1, order + 1):
        for b in range(degree + 1):
            term = F.lit(1.0)
            for factor, times in ((u, degree - b), (v, b)):
                for _ in range(times):
                    term = term * factor
            out.append(term)
    return out
