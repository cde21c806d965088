"""Extractors by name: sequences to long features (sequence_id, feature, value)."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import id_column, step_column, value_columns
from tidemark.operators.features import basic, compact, drift, efficient, signal
from tidemark.operators.features.rows import features_long


def _comprehensive(df: DataFrame, **kwargs) -> DataFrame:
    return efficient.efficient_features(df, comprehensive=True, **kwargs)


def _population(df: DataFrame, **kwargs) -> DataFrame:
    return basic.statistical_features(df, sample_std=False, **kwargs)


EXTRACTORS: dict[str, Callable[..., DataFrame]] = {
    "statistics_sample": basic.statistical_features,
    "statistics_population": _population,
    "minimal": basic.minimal_features,
    "base": basic.base_features,
    "compact": compact.compact_features,
    "efficient": efficient.efficient_features,
    "comprehensive": _comprehensive,
    "signal_statistical": signal.statistical_domain,
    "signal_temporal": signal.temporal_domain,
    "mixed": signal.mixed_set,
    "lag_correlations": basic.lag_correlations,
    "drift": drift.drift_features,
}

# Other names under which the sets are known (fixed names).
ALIASES = {
    "statistics": "statistics_sample",
    "polars_statistics": "statistics_sample",
    "numpy": "statistics_population",
    "numpy_statistical": "statistics_population",
    "numba": "compact",
    "numba_efficient": "compact",
    "tsfel": "signal_statistical",
    "tsfresh": "efficient",
    "tsfresh_minimal": "minimal",
    "tsfresh_efficient": "efficient",
    "tsfresh_comprehensive": "comprehensive",
}
# Common name of the number of Fourier terms, by the parameter each set calls it.
FOURIER_PARAMETER = {"compact": "n_fft_coeffs", "efficient": "fft_coefficients", "comprehensive": "fft_coefficients"}


def extractor_name(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in EXTRACTORS:
        raise KeyError(f"unknown extractor {name}")
    return name


def extract(sequences: DataFrame, extractor: str | Callable, channels=None, **params) -> DataFrame:
    """Run a named extractor, or a function (sequences, ...) -> wide or long features.

    Names are `<channel>__<feature>`; missing and non-finite values are 0.
    """
    if isinstance(extractor, str):
        name = extractor_name(extractor)
        fn = EXTRACTORS[name]
        terms = params.pop("fft_coefficients", None)
        if terms is not None and name in FOURIER_PARAMETER:
            params[FOURIER_PARAMETER[name]] = terms
    else:
        fn = extractor
    ids = id_column(sequences)
    if channels is None:
        channels = value_columns(sequences, [ids, step_column(sequences)])
    offered = {"ids": ids, "channels": channels}
    accepted = inspect.signature(fn).parameters
    open_ended = any(p.kind is inspect.Parameter.VAR_KEYWORD for p in accepted.values())
    wide = fn(sequences, **{k: v for k, v in offered.items() if open_ended or k in accepted}, **params)
    wide = wide.withColumnRenamed(ids, "sequence_id")
    if {"feature", "value"} <= set(wide.columns):
        return wide.select("sequence_id", "feature", "value")
    keys = ["sequence_id", "channel"] if "channel" in wide.columns else ["sequence_id"]
    long = features_long(wide, keys)
    if "channel" in wide.columns:
        long = long.withColumn("feature", F.concat_ws("__", "channel", "feature"))
    return long.select("sequence_id", "feature", "value")
