"""Column-name rules: pure functions from names to names."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

# Keywords of time-series feature names and the suffixes kept for each.
FEATURE_SUFFIXES: dict[str, tuple[str, ...]] = {
    "standard_deviation": ("__r_0.0", "__r_0.25", "__r_0.6", "__r_0.9"),
    "quantile": ("__q_0.2", "__q_0.8"),
    "autocorrelation": ("__lag_0", "__lag_5", "__lag_9"),
    "fft_coefficient": ("__coeff_0", "__coeff_33", "__coeff_99"),
    "cwt_coefficients": ("__coeff_0", "__coeff_6", "__coeff_12"),
    "symmetry_looking": ("__r_0.0", "__r_0.25", "__r_0.65", "__r_0.9"),
    "ar_coefficient": ("__coeff_0", "__coeff_3", "__coeff_6", "__coeff_10"),
}


def keep_feature(name: str, suffixes: Mapping[str, Sequence[str]] = FEATURE_SUFFIXES) -> bool:
    """The first keyword in the name decides; one of its suffixes must occur."""
    keyword = next((k for k in suffixes if k in name), None)
    return keyword is None or any(s in name for s in suffixes[keyword])


def filter_by_suffix(names: Iterable[str]) -> list[str]:
    """D13 over a list, applied before the features are computed."""
    return [n for n in names if keep_feature(n)]


def key_columns_first(df: DataFrame, keywords: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Columns whose name contains a keyword come first."""
    is_key = lambda c: any(k in c.lower() for k in keywords)
    return df.select(
        *[f"`{c}`" for c in df.columns if is_key(c)], *[f"`{c}`" for c in df.columns if not is_key(c)]
    )


def clean_names(df: DataFrame) -> DataFrame:
    """Keep ``[A-Za-z0-9_]`` only; a repeated name gets its position appended."""
    seen: set[str] = set()
    names = []
    for i, c in enumerate(df.columns):
        name = re.sub(r"[^A-Za-z0-9_]", "", c)
        if name in seen:
            name = f"{name}_{i}"
        seen.add(name)
        names.append(name)
    return df.toDF(*names)


def select_features(
    columns: Iterable[str], ratio_columns: Iterable[str], amount_columns: Iterable[str] = ()
) -> list[str]:
    """Drop absolute amounts; keep ``_ts_``, ratio, ``OverMC_`` and ``adaptiveMC_`` columns."""
    ratios, amounts = set(ratio_columns), set(amount_columns)
    dropped = amounts - ratios
    return [
        c
        for c in columns
        if c not in dropped
        and ("_ts_" in c or c in ratios or c.startswith("OverMC_") or c.startswith("adaptiveMC_"))
    ]
