"""Column expressions shared by the operators (projection and cleaning)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID_NAMES = ("sequence_id", "id")
STEP_NAMES = ("step", "time")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def resolve_column(df: DataFrame, names: Sequence[str]) -> str:
    """First of the accepted names that the table has."""
    for name in names:
        if name in df.columns:
            return name
    raise KeyError(f"none of {list(names)} in {df.columns}")


def id_column(df: DataFrame) -> str:
    return resolve_column(df, ID_NAMES)


def step_column(df: DataFrame) -> str:
    return resolve_column(df, STEP_NAMES)


def select_except(df: DataFrame, excluded: Iterable[str]) -> DataFrame:
    excluded = set(excluded)
    return df.select(*[c for c in df.columns if c not in excluded])


def value_columns(df: DataFrame, excluded: Iterable[str]) -> list[str]:
    """Numeric columns outside the excluded ones."""
    excluded = set(excluded)
    return [
        f.name
        for f in df.schema.fields
        if f.name not in excluded and isinstance(f.dataType, T.NumericType)
    ]


def recode(c: Column | str, mapping: Mapping, default=None) -> Column:
    """Dictionary recode; unmapped values become `default`."""
    c = _col(c)
    out = F.lit(default)
    for key, value in reversed(list(mapping.items())):
        out = F.when(c == F.lit(key), F.lit(value)).otherwise(out)
    return out


def finite_or_null(c: Column | str) -> Column:
    c = _col(c).cast("double")
    bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(~bad, c)


def sanitise(c: Column | str) -> Column:
    """Null, NaN and the infinities become 0.0."""
    return F.coalesce(finite_or_null(c), F.lit(0.0))


def fill_missing(c: Column | str, value: float = 0.0) -> Column:
    """NaN and null become `value`; infinities stay."""
    c = _col(c).cast("double")
    return F.coalesce(F.nanvl(c, F.lit(value)), F.lit(value))


def parse_number(c: Column | str, default: float | None = 0.0) -> Column:
    """Trimmed text to double; text that is no number becomes `default`."""
    parsed = F.trim(_col(c).cast("string")).try_cast("double")
    return parsed if default is None else F.coalesce(parsed, F.lit(default))


def parse_thousands(c: Column | str, separator: str = ",") -> Column:
    return F.regexp_replace(F.trim(_col(c)), re.escape(separator), "").try_cast("double")


def null_label(c: Column | str, label: str = "none") -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(label))


def concat_key(*cols: Column | str, sep: str = " + ") -> Column:
    return F.concat_ws(sep, *[_col(c) for c in cols])


def ratio(a: Column | str, b: Column | str, default: float | None = 0.0) -> Column:
    """a / b, and `default` where b is 0 or either is missing."""
    out = F.try_divide(_col(a).cast("double"), _col(b).cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def magnitude(*cols: Column | str) -> Column:
    total = F.lit(0.0)
    for c in cols:
        total = total + _col(c) * _col(c)
    return F.sqrt(total)


def one_hot(df: DataFrame, column: str, categories: Sequence, prefix: str | None = None) -> DataFrame:
    """One double column per category; rows of an unknown category are all zero."""
    prefix = prefix or column
    flags = {
        f"{prefix}_{c}": F.coalesce((F.col(column) == F.lit(c)).cast("double"), F.lit(0.0))
        for c in categories
    }
    return df.withColumns(flags).drop(column)


def math_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """log, log1p and square of each column; sum, product and ratio of each pair."""
    out = {}
    for c in columns:
        x = F.col(c).cast("double")
        out[f"{c}_log"] = F.when(x > 0, F.log(x))
        out[f"{c}_log1p"] = F.when(x > -1, F.log1p(x))
        out[f"{c}_square"] = x * x
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            out[f"{a}_plus_{b}"] = F.col(a).cast("double") + F.col(b)
            out[f"{a}_times_{b}"] = F.col(a).cast("double") * F.col(b)
            out[f"{a}_per_{b}"] = ratio(a, b, None)
    return df.withColumns(out)


def align_columns(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The train columns in train order; columns the table lacks are 0.0."""
    present = set(df.columns)
    picked = [
        F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c)
        if c in present
        else F.lit(0.0).alias(c)
        for c in columns
    ]
    return df.select(*keys, *picked)


def natural_order(names: Iterable[str]) -> list[str]:
    """Names sorted with their digit runs compared as numbers."""
    def key(name: str):
        return [(1, int(p), "") if p.isdigit() else (0, 0, p) for p in re.split(r"(\d+)", name)]

    return sorted(names, key=key)


def horizon_columns(columns: Iterable[str], metric: str) -> dict[int, list[str]]:
    """Columns such as RMSE_H1, `RMSE H1` or `RMSE 1` by horizon."""
    pattern = re.compile(rf"^{re.escape(metric)}[ _]?H?(\d+)$", re.IGNORECASE)
    found: dict[int, list[str]] = {}
    for c in columns:
        match = pattern.match(c.replace("_", " ") if " " in metric else c)
        if match:
            found.setdefault(int(match.group(1)), []).append(c)
    return dict(sorted(found.items()))


def encode_array(c: Column | str) -> Column:
    return F.to_json(_col(c))


def decode_array(c: Column | str) -> Column:
    """JSON array, or a bracketed list parted by commas or blanks, to array<double>."""
    c = _col(c)
    inner = F.trim(F.regexp_replace(c, r"[\[\]\(\)]", " "))
    parts = F.filter(F.split(inner, r"[\s,]+"), lambda p: p != "")
    return F.transform(parts, lambda p: p.try_cast("double"))


def feature_parts(c: Column | str) -> dict[str, Column]:
    """Channel, feature and parameter part of `<channel>__<feature>[__param]`."""
    parts = F.split(_col(c), "__")
    return {
        "channel": F.get(parts, F.lit(0)),
        "feature": F.get(parts, F.lit(1)),
        "parameter": F.array_join(F.slice(parts, 3, F.size(parts)), "__"),
    }


def swap_fft_parameters(c: Column | str) -> Column:
    """`..coeff_k__attr_"a"` and `..attr_"a"__coeff_k` are the same feature: coefficient second."""
    return F.regexp_replace(_col(c), r'__coeff_(\d+)__attr_("?\w+"?)', r"__attr_$2__coeff_$1")


# The families of the parity report and the parts of names that decide, in order of precedence.
FAMILIES = (
    ("Quantiles", ("quantile", "median")),
    ("Autocorrelation", ("autocorrelation",)),
    ("Linear Trend", ("linear_trend", "trend")),
    ("FFT Coefficients", ("fft", "fourier")),
    ("Higher Order Moments", ("skewness", "kurtosis")),
    ("Dispersion (Var/Std)", ("variance", "standard_deviation")),
    ("Location & Energy", ("mean", "minimum", "maximum", "root_mean_square", "abs_energy", "absolute_maximum")),
    ("Dynamics & Extremes", ("change", "strike", "count_above", "count_below", "ratio")),
)


def feature_family(c: Column | str) -> Column:
    """Family of a feature name; the first row with a matching part counts."""
    name = F.lower(_col(c))
    out = F.lit("Other")
    for family, parts in reversed(FAMILIES):
        out = F.when(name.rlike("|".join(parts)), F.lit(family)).otherwise(out)
    return out


def preset_parts(c: Column | str) -> dict[str, Column]:
    """Library, level and number of Fourier terms of a label such as `A-Efficient-25FFT`."""
    c = _col(c)
    parts = F.split(c, "-")
    return {
        "library": F.get(parts, F.lit(0)),
        "level": F.get(parts, F.lit(1)),
        "fft_terms": F.regexp_extract(c, r"-(\d+)FFT", 1).try_cast("int"),
    }
