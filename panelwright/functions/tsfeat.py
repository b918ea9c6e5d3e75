"""Summary features of short, sorted value arrays.

Each feature is a SQL expression over ``x`` (the values in time order) and its
moments ``n``, ``m`` (mean), ``sd`` (population deviation), ``mn``, ``mx``,
``md`` (median); all of it stays in the JVM.  Partial autocorrelation and
autoregression need a linear solve and run as one vectorised Arrow function.
Where all features are wanted, :func:`feature_matrix` computes them together
for a batch of windows: sorted values, moments, differences and absolute sums
once each, and one vector per window instead of a column per feature.
Feature names and definitions are those of the tsfresh documentation.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SUM = "aggregate({0}, 0D, (a, v) -> a + v)"
# Pairs (x[i], x[i+lag]) and triples are built from index sequences.
_AT = "transform(sequence(0, {last}), i -> {body})"

# The parameter lists of the kept features.
SYMMETRY_R = ("0.0", "0.25", "0.65", "0.9")
LARGE_STD_R = ("0.0", "0.25", "0.6", "0.9")
BEYOND_SIGMA_R = ("0.5", "1", "1.5", "2", "2.5", "3", "5", "6", "7", "10")
AUTOCORRELATION_LAGS = (0, 5, 9)
PEAK_SUPPORT = (1, 3, 5, 10, 50)
RICKER_WIDTHS = (2, 5, 10, 20)
RICKER_COEFFICIENTS = (0, 6, 12)
PACF_LAGS = tuple(range(10))
AR_COEFFICIENTS = (0, 3, 6, 10)
AR_ORDER = 10


def _sum(array: str) -> str:
    return _SUM.format(array)


def _over(last: str, body: str, need: str) -> str:
    """Sum of ``body`` for i in 0..last, null when ``need`` fails."""
    return f"CASE WHEN {need} THEN {_sum(_AT.format(last=last, body=body))} END"


def _div(a: str, b: str) -> str:
    return f"try_divide({a}, {b})"


def _longest(test: str) -> str:
    run = "named_struct('c', CASE WHEN {t} THEN a.c + 1 ELSE 0 END, 'b', greatest(a.b, CASE WHEN {t} THEN a.c + 1 ELSE 0 END))".format(t=test)
    return f"aggregate(x, named_struct('c', 0, 'b', 0), (a, v) -> {run}, a -> a.b)"


def quantile(q: float) -> str:
    s, at = "array_sort(x)", f"({q}D * (n - 1))"
    lo = f"element_at({s}, CAST(floor({at}) AS INT) + 1)"
    hi = f"element_at({s}, CAST(ceil({at}) AS INT) + 1)"
    return f"({lo} + ({hi} - {lo}) * ({at} - floor({at})))"


def _trend() -> dict[str, str]:
    mi = "((n - 1) / 2D)"
    sxx = "(n * (n * n - 1D) / 12D)"
    sxy = _sum(_AT.format(last="n - 1", body=f"(i - {mi}) * (x[i] - m)"))
    slope = _div(sxy, sxx)
    syy = "(n * sd * sd)"
    r = _div(sxy, f"sqrt({sxx} * {syy})")
    return {
        'linear_trend__attr_"slope"': slope,
        'linear_trend__attr_"intercept"': f"(m - {slope} * {mi})",
        'linear_trend__attr_"rvalue"': f"CASE WHEN sd > 0 THEN {r} END",
    }


def ricker(points: int, width: float) -> np.ndarray:
    """The Ricker wavelet sampled at ``points``."""
    t = np.arange(points) - (points - 1) / 2
    s = (t / width) ** 2
    return 2 / (math.sqrt(3 * width) * math.pi**0.25) * (1 - s) * np.exp(-s / 2)


def ricker_weights(n: int, width: int, coefficient: int) -> np.ndarray:
    """Weights w with ``w . x`` = the wavelet coefficient at one position of a window of n points.

    The transform is linear in x, so its matrix column is found by transforming unit vectors.
    """
    wave = ricker(min(10 * width, n), width)[::-1]
    return np.array([np.convolve(e, wave, mode="same")[coefficient] for e in np.eye(n)])


def _dot(weights: Iterable[float]) -> str:
    literal = ", ".join(f"{w!r}D" for w in map(float, weights))
    return _sum(f"zip_with(x, array({literal}), (a, b) -> a * b)")


def feature_expressions(window: int = 12, fourier: Iterable[int] = (0,)) -> dict[str, str]:
    """All JVM features by name, for windows of ``window`` points."""
    sumsq = _sum("transform(x, v -> v * v)")
    diff = _AT.format(last="n - 2", body="x[i + 1] - x[i]")
    absdiff = f"CASE WHEN n > 1 THEN {_sum(f'transform({diff}, v -> abs(v))')} END"
    energy = f"CASE WHEN n > 1 THEN sqrt({_sum(f'transform({diff}, v -> v * v)')}) END"
    moment = lambda k: _sum(f"transform(x, v -> pow(v - m, {k}))")
    s2 = "(n * sd * sd / (n - 1D))"
    out = {
        "sum_values": "(m * n)",
        "mean": "m",
        "median": "md",
        "variance": "(sd * sd)",
        "standard_deviation": "sd",
        "minimum": "mn",
        "maximum": "mx",
        "root_mean_square": f"sqrt({sumsq} / n)",
        "abs_energy": sumsq,
        "mean_change": "CASE WHEN n > 1 THEN (x[n - 1] - x[0]) / (n - 1D) END",
        "mean_abs_change": f"{absdiff} / (n - 1D)",
        "absolute_sum_of_changes": absdiff,
        "count_above_mean": "size(filter(x, v -> v > m))",
        "count_below_mean": "size(filter(x, v -> v < m))",
        "first_location_of_maximum": "(array_position(x, mx) - 1D) / n",
        "last_location_of_maximum": "1D - (array_position(reverse(x), mx) - 1D) / n",
        "first_location_of_minimum": "(array_position(x, mn) - 1D) / n",
        "last_location_of_minimum": "1D - (array_position(reverse(x), mn) - 1D) / n",
        "longest_strike_above_mean": _longest("v > m"),
        "longest_strike_below_mean": _longest("v < m"),
        "has_duplicate": "CAST(size(array_distinct(x)) < n AS INT)",
        "has_duplicate_max": "CAST(size(filter(x, v -> v = mx)) > 1 AS INT)",
        "has_duplicate_min": "CAST(size(filter(x, v -> v = mn)) > 1 AS INT)",
        "variation_coefficient": _div("sd", "m"),
        "skewness": f"CASE WHEN n > 2 AND sd > 0 THEN n / ((n - 1D) * (n - 2D)) * {moment(3)} / pow({s2}, 1.5D) END",
        "kurtosis": f"CASE WHEN n > 3 AND sd > 0 THEN n * (n + 1D) / ((n - 1D) * (n - 2D) * (n - 3D)) * {moment(4)} / pow({s2}, 2)"
        " - 3D * (n - 1D) * (n - 1D) / ((n - 2D) * (n - 3D)) END",
        "quantile__q_0.2": quantile(0.2),
        "quantile__q_0.8": quantile(0.8),
        "cid_ce__normalize_True": f"CASE WHEN sd > 0 THEN {energy} / sd ELSE 0D END",
        "cid_ce__normalize_False": energy,
        **_trend(),
    }
    for lag in AUTOCORRELATION_LAGS:
        total = _over(f"n - 1 - {lag}", f"(x[i] - m) * (x[i + {lag}] - m)", f"n > {lag} AND sd > 0")
        out[f"autocorrelation__lag_{lag}"] = f"{total} / ((n - {lag}) * sd * sd)"
    for lag in (1, 2, 3):
        last, need = f"n - 1 - {2 * lag}", f"n > {2 * lag}"
        a, b, c = "x[i]", f"x[i + {lag}]", f"x[i + {2 * lag}]"
        out[f"c3__lag_{lag}"] = f"{_over(last, f'{c} * {b} * {a}', need)} / (n - {2 * lag})"
        out[f"time_reversal_asymmetry_statistic__lag_{lag}"] = (
            f"{_over(last, f'{c} * {c} * {b} - {b} * {a} * {a}', need)} / (n - {2 * lag})"
        )
    for r in SYMMETRY_R:
        out[f"symmetry_looking__r_{r}"] = f"CAST(abs(m - md) < {r}D * (mx - mn) AS INT)"
    for r in LARGE_STD_R:
        out[f"large_standard_deviation__r_{r}"] = f"CAST(sd > {r}D * (mx - mn) AS INT)"
    for r in BEYOND_SIGMA_R:
        out[f"ratio_beyond_r_sigma__r_{r}"] = f"size(filter(x, v -> abs(v - m) > {r}D * sd)) / CAST(n AS DOUBLE)"
    for q in ("0.2", "0.8"):
        share = "aggregate(x, named_struct('s', 0D, 'k', 0), (a, v) -> named_struct('s', a.s + abs(v), 'k', a.k + CAST(a.s + abs(v) < {q}D * {t} AS INT)), a -> a.k)"
        total = _sum("transform(x, v -> abs(v))")
        out[f"index_mass_quantile__q_{q}"] = f"CASE WHEN {total} > 0 THEN ({share.format(q=q, t=total)} + 1D) / n END"
    for k in PEAK_SUPPORT:
        inside = f"forall(sequence(1, {k}), j -> x[i] > x[i - j] AND x[i] > x[i + j])"
        out[f"number_peaks__n_{k}"] = (
            f"CASE WHEN n > {2 * k} THEN size(filter(sequence({k}, n - 1 - {k}), i -> {inside})) ELSE 0 END"
        )
    for k in fourier:
        angle = f"{-2 * math.pi * k!r}D * i / n"
        real = _sum(_AT.format(last="n - 1", body=f"x[i] * cos({angle})"))
        imag = _sum(_AT.format(last="n - 1", body=f"x[i] * sin({angle})"))
        tail = f"__coeff_{k}"
        have = f"CASE WHEN {k} <= floor(n / 2) THEN {{0}} END"
        out[f'fft_coefficient__attr_"real"{tail}'] = have.format(real)
        out[f'fft_coefficient__attr_"imag"{tail}'] = have.format(imag if k else "0D")
        out[f'fft_coefficient__attr_"abs"{tail}'] = have.format(f"sqrt(pow({real}, 2) + pow({imag}, 2))")
        out[f'fft_coefficient__attr_"angle"{tail}'] = have.format(f"degrees(atan2({imag if k else '0D'}, {real}))")
    widths = ", ".join(map(str, RICKER_WIDTHS))
    for w in RICKER_WIDTHS:
        for c in RICKER_COEFFICIENTS:
            name = f"cwt_coefficients__coeff_{c}__w_{w}__widths_({widths})"
            if c < window:
                out[name] = f"CASE WHEN n = {window} THEN {_dot(ricker_weights(window, w, c))} END"
            else:
                out[name] = "CAST(NULL AS DOUBLE)"
    return out


def with_moments(values: str) -> list[Column]:
    """``x``, ``n``, ``m``, ``sd``, ``mn``, ``mx``, ``md`` of an array column, to be added in two steps."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    return [F.col(values).alias("x"), n.alias("n"), mean.alias("m"), F.array_min(values).alias("mn"), F.array_max(values).alias("mx")]


def _levinson(acov: np.ndarray, lags: int) -> np.ndarray:
    """Partial autocorrelations by Durbin's recursion, for a batch of autocovariances."""
    rows = acov.shape[0]
    out = np.full((rows, lags + 1), np.nan)
    out[:, 0] = 1.0
    phi = np.zeros((rows, lags + 1))
    var = acov[:, 0].copy()
    for k in range(1, lags + 1):
        known = (phi[:, 1:k] * acov[:, k - 1 : 0 : -1]).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            reflect = (acov[:, k] - known) / var
        phi[:, 1:k] = phi[:, 1:k] - reflect[:, None] * phi[:, k - 1 : 0 : -1]
        phi[:, k] = reflect
        var = var * (1 - reflect**2)
        out[:, k] = reflect
    return out


def partial_autocorrelations(x: np.ndarray, lags: Iterable[int] = PACF_LAGS) -> np.ndarray:
    """For a batch (rows, n): one column per lag, NaN beyond ``n // 2 - 1``."""
    lags = list(lags)
    n = x.shape[1]
    top = min(max(lags), n // 2 - 1)
    result = np.full((x.shape[0], len(lags)), np.nan)
    if top < 1:
        return result
    c = x - x.mean(axis=1, keepdims=True)
    acov = np.stack([(c[:, : n - k] * c[:, k:]).sum(axis=1) / (n - k) for k in range(top + 1)], axis=1)
    pacf = _levinson(acov, top)
    for j, lag in enumerate(lags):
        if lag <= top:
            result[:, j] = pacf[:, lag]
    return result


def ar_coefficients(x: np.ndarray, order: int = AR_ORDER, wanted: Iterable[int] = AR_COEFFICIENTS) -> np.ndarray:
    """Least-squares autoregression with constant; NaN when the window has too few points for the order."""
    wanted = list(wanted)
    rows, n = x.shape
    result = np.full((rows, len(wanted)), np.nan)
    if n - order < order + 1:
        return result
    y = x[:, order:]
    design = np.stack([np.ones_like(y)] + [x[:, order - k : n - k] for k in range(1, order + 1)], axis=2)
    params = (np.linalg.pinv(design) @ y[:, :, None])[:, :, 0]
    for j, k in enumerate(wanted):
        if k <= order:
            result[:, j] = params[:, k]
    return result


def solver_feature_names(order: int = AR_ORDER) -> list[str]:
    """Names of the features that need a linear solve."""
    return [f"partial_autocorrelation__lag_{k}" for k in PACF_LAGS] + [
        f"ar_coefficient__coeff_{k}__k_{order}" for k in AR_COEFFICIENTS
    ]


def solver_features(order: int = AR_ORDER):
    """An Arrow function from the value array to an array of the solver features.

    Windows of equal length are solved together as one batch.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(values: pd.Series) -> pd.Series:
        lengths = values.map(len)
        out = pd.Series([None] * len(values), index=values.index, dtype=object)
        for n, part in values.groupby(lengths):
            if n == 0:
                continue
            batch = np.stack(part.to_numpy()).astype(float)
            both = np.hstack([partial_autocorrelations(batch), ar_coefficients(batch, order)])
            for i, row in zip(part.index, both, strict=True):
                out[i] = [None if math.isnan(v) or math.isinf(v) else float(v) for v in row]
        return out

    return solve


def _quantile_columns(ordered: np.ndarray, q: float) -> np.ndarray:
    at = q * (ordered.shape[1] - 1)
    low, high = ordered[:, math.floor(at)], ordered[:, math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def _strike(test: np.ndarray) -> np.ndarray:
    """Longest run of true values in each row."""
    run = best = np.zeros(len(test))
    for column in test.T:
        run = (run + 1) * column
        best = np.maximum(best, run)
    return best


def _peaks(x: np.ndarray, support: int) -> np.ndarray:
    n = x.shape[1]
    if n <= 2 * support:
        return np.zeros(len(x))
    inner = x[:, support : n - support]
    higher = np.ones(inner.shape, bool)
    for j in range(1, support + 1):
        higher &= (inner > x[:, support - j : n - support - j]) & (inner > x[:, support + j : n - support + j])
    return higher.sum(axis=1)


def feature_names(window: int = 12, fourier: Iterable[int] = (0,)) -> list[str]:
    """Names of all features in the order of the vector: those of the expressions, then those of the solver."""
    return [*feature_expressions(window, fourier), *solver_feature_names()]


def feature_matrix(x: np.ndarray, window: int = 12, fourier: Iterable[int] = (0,)) -> dict[str, np.ndarray]:
    """All features of a batch of equally long windows (rows, n) by name; NaN stands for none."""
    rows, n = x.shape
    none = np.full(rows, np.nan)
    s = np.sort(x, axis=1)
    mn, mx, md = s[:, 0], s[:, -1], _quantile_columns(s, 0.5)
    # Values that are all equal are their mean, whatever a sum rounds to, and have deviation zero.
    m = np.where(mn == mx, mn, x.mean(axis=1))
    c = x - m[:, None]
    square = (c * c).sum(axis=1)
    sd = np.where(mn == mx, 0.0, np.sqrt(square / n))
    var, moving = sd * sd, sd > 0
    d = np.diff(x, axis=1)
    absolute = np.cumsum(np.abs(x), axis=1)
    energy, mass = (x * x).sum(axis=1), absolute[:, -1]
    rough, jumps = np.sqrt((d * d).sum(axis=1)), np.abs(d).sum(axis=1)
    ramp = np.arange(n) - (n - 1) / 2
    sxx = n * (n * n - 1) / 12
    sxy = (c * ramp).sum(axis=1)
    several = n > 1
    slope = sxy / sxx if several else none
    ends = lambda value, last: np.argmax((x == value[:, None])[:, ::-1 if last else 1], axis=1)
    out = {
        "sum_values": m * n,
        "mean": m,
        "median": md,
        "variance": var,
        "standard_deviation": sd,
        "minimum": mn,
        "maximum": mx,
        "root_mean_square": np.sqrt(energy / n),
        "abs_energy": energy,
        "mean_change": (x[:, -1] - x[:, 0]) / (n - 1) if several else none,
        "mean_abs_change": jumps / (n - 1) if several else none,
        "absolute_sum_of_changes": jumps if several else none,
        "count_above_mean": (c > 0).sum(axis=1),
        "count_below_mean": (c < 0).sum(axis=1),
        "first_location_of_maximum": ends(mx, False) / n,
        "last_location_of_maximum": 1 - ends(mx, True) / n,
        "first_location_of_minimum": ends(mn, False) / n,
        "last_location_of_minimum": 1 - ends(mn, True) / n,
        "longest_strike_above_mean": _strike(c > 0),
        "longest_strike_below_mean": _strike(c < 0),
        "has_duplicate": (np.diff(s, axis=1) == 0).any(axis=1),
        "has_duplicate_max": (x == mx[:, None]).sum(axis=1) > 1,
        "has_duplicate_min": (x == mn[:, None]).sum(axis=1) > 1,
        "variation_coefficient": sd / m,
        "quantile__q_0.2": _quantile_columns(s, 0.2),
        "quantile__q_0.8": _quantile_columns(s, 0.8),
        "cid_ce__normalize_True": (np.where(moving, rough / sd, 0.0)) if several else np.where(moving, np.nan, 0.0),
        "cid_ce__normalize_False": rough if several else none,
        'linear_trend__attr_"slope"': slope,
        'linear_trend__attr_"intercept"': m - slope * (n - 1) / 2,
        'linear_trend__attr_"rvalue"': np.where(moving, sxy / np.sqrt(sxx * n * var), np.nan) if several else none,
    }
    sample = n * var / (n - 1) if several else none
    skew = n / ((n - 1) * (n - 2)) * (c**3).sum(axis=1) / sample**1.5 if n > 2 else none
    out["skewness"] = np.where(moving, skew, np.nan)
    if n > 3:
        kurt = n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * (c**4).sum(axis=1) / sample**2 - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))
    out["kurtosis"] = np.where(moving, kurt, np.nan) if n > 3 else none
    for lag in AUTOCORRELATION_LAGS:
        total = (c[:, : n - lag] * c[:, lag:]).sum(axis=1) if n > lag else none
        out[f"autocorrelation__lag_{lag}"] = np.where(moving, total / ((n - lag) * var), np.nan) if n > lag else none
    for lag in (1, 2, 3):
        k = n - 2 * lag
        a, b, e = (x[:, i * lag : i * lag + k] for i in range(3)) if k > 0 else (none[:, None],) * 3
        out[f"c3__lag_{lag}"] = (e * b * a).mean(axis=1)
        out[f"time_reversal_asymmetry_statistic__lag_{lag}"] = (e * e * b - b * a * a).mean(axis=1)
    span = mx - mn
    for r in SYMMETRY_R:
        out[f"symmetry_looking__r_{r}"] = np.abs(m - md) < float(r) * span
    for r in LARGE_STD_R:
        out[f"large_standard_deviation__r_{r}"] = sd > float(r) * span
    for r in BEYOND_SIGMA_R:
        out[f"ratio_beyond_r_sigma__r_{r}"] = (np.abs(c) > float(r) * sd[:, None]).sum(axis=1) / n
    for q in ("0.2", "0.8"):
        out[f"index_mass_quantile__q_{q}"] = np.where(mass > 0, ((absolute < float(q) * mass[:, None]).sum(axis=1) + 1) / n, np.nan)
    for k in PEAK_SUPPORT:
        out[f"number_peaks__n_{k}"] = _peaks(x, k)
    for k in fourier:
        angle = -2 * math.pi * k * np.arange(n) / n
        real, imag = (x * np.cos(angle)).sum(axis=1), (x * np.sin(angle)).sum(axis=1) if k else np.zeros(rows)
        parts = {"real": real, "imag": imag, "abs": np.hypot(real, imag), "angle": np.degrees(np.arctan2(imag, real))}
        for attr, value in parts.items():
            out[f'fft_coefficient__attr_"{attr}"__coeff_{k}'] = value if k <= n // 2 else none
    widths = ", ".join(map(str, RICKER_WIDTHS))
    for w in RICKER_WIDTHS:
        for k in RICKER_COEFFICIENTS:
            name = f"cwt_coefficients__coeff_{k}__w_{w}__widths_({widths})"
            out[name] = x @ ricker_weights(window, w, k) if n == window and k < window else none
    solved = np.hstack([partial_autocorrelations(x), ar_coefficients(x)])
    return out | dict(zip(solver_feature_names(), solved.T, strict=True))


def feature_vectors(names: list[str], window: int = 12, fourier: Iterable[int] = (0,)):
    """A function over Arrow batches that puts the vector of the named features in place of the last column."""
    fourier = list(fourier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            lengths, starts = np.diff(values.offsets.to_numpy()), values.offsets.to_numpy()[:-1]
            flat = values.values.to_numpy(zero_copy_only=False)
            out = np.full((batch.num_rows, len(names)), np.nan)
            for n in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == n)
                x = flat[starts[at][:, None] + np.arange(n)].astype(float)
                with np.errstate(all="ignore"):
                    found = feature_matrix(x, window, fourier)
                out[at] = np.stack([found[f] for f in names], axis=1)
            cells = pa.array(out.ravel(), mask=~np.isfinite(out.ravel()))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(names))
            vector = pa.ListArray.from_arrays(offsets, cells)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vector], names=batch.schema.names)

    return run


# Tasks get the solver with its module, also where the package is not installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
