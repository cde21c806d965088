"""Feature sets on hand-made sequences and against plain numpy."""

import math

import numpy as np
import pytest

from tidemark.operators.features import basic, compact, drift, efficient, signal
from tidemark.operators.features.extractors import EXTRACTORS, extract


def frame(spark, sequences):
    rows = [(s, i, None if v is None else float(v)) for s, xs in enumerate(sequences) for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "sequence_id long, step int, v double").repartition(3)


def wide(df):
    return {r["sequence_id"]: r.asDict() for r in df.collect()}


def test_five_statistics(spark):
    df = frame(spark, [[1, 2, 3, 4, 5], [10, 20, 30, 40, 50]])
    sample, population = wide(basic.statistical_features(df)), wide(basic.statistical_features(df, sample_std=False))
    assert list(sample[0]) == ["sequence_id", *[f"v__{n}" for n in ("mean", "std", "min", "max", "energy")]]
    assert sample[0]["v__mean"] == 3 and sample[1]["v__max"] == 50 and sample[0]["v__energy"] == 55
    assert math.isclose(sample[0]["v__std"], math.sqrt(2.5)) and math.isclose(population[0]["v__std"], math.sqrt(2))


def test_long_table_with_other_names(spark):
    df = spark.createDataFrame([(0, t, float(v)) for t, v in enumerate((1, 2, 3))], "id int, time int, val double")
    assert basic.statistical_features(df).first()["val__mean"] == 2
    with pytest.raises(KeyError):
        basic.statistical_features(df.withColumnRenamed("id", "other"))


@pytest.fixture(scope="module")
def compact_rows(spark):
    cases = {"one": [5], "flat": [3, 3, 3, 3], "pair": [0, 10], "line": [1, 2, 3, 4], "six": [1, 2, 3, 4, 5, 6]}
    got = wide(compact.compact_features(frame(spark, cases.values()), n_fft_coeffs=20))
    return {name: got[i] for i, name in enumerate(cases)}


def test_compact_edge_cases(compact_rows):
    one, flat, pair, six = (compact_rows[n] for n in ("one", "flat", "pair", "six"))
    assert one["mean"] == 5 and one["standard_deviation"] == 0 and one["mean_change"] == 0
    assert flat["skewness"] == 0 and flat["kurtosis"] == 0 and flat["longest_strike_above_mean"] == 0
    assert pair["variance_larger_than_standard_deviation"] == 1 and pair["mean_change"] == 10
    assert six["mean"] == 3.5 and six["count_above_mean"] == 3 and six["longest_strike_below_mean"] == 3
    assert six["first_location_of_maximum"] == 5 / 6 and six["last_location_of_minimum"] == 0


def test_compact_trend(compact_rows):
    line, flat = compact_rows["line"], compact_rows["flat"]
    assert [round(line[f'linear_trend__attr_"{a}"'], 12) for a in ("slope", "intercept", "rvalue")] == [1, 1, 1]
    assert [flat[f'linear_trend__attr_"{a}"'] for a in ("slope", "intercept", "rvalue")] == [0, 3, 0]


def test_compact_autocorrelation_and_quantiles(spark, compact_rows):
    three = wide(compact.compact_features(frame(spark, [[1, 2, 3]]), n_fft_coeffs=0))[0]
    assert not [c for c in three if c.startswith("fft")]
    assert len([c for c in three if c.startswith("autocorrelation")]) == 10
    assert three["autocorrelation__lag_3"] == 0 and math.isclose(three["autocorrelation__lag_2"], -1 / 2 * 3)
    six = compact_rows["six"]
    for q in (0.1, 0.4, 0.9):
        assert math.isclose(six[f"quantile__q_{q}"], np.quantile([1, 2, 3, 4, 5, 6], q))


def test_compact_fourier_is_padded_with_zeros(compact_rows):
    line = compact_rows["line"]
    spectrum = np.fft.rfft([1, 2, 3, 4])
    for k in range(20):
        want = spectrum[k] if k < len(spectrum) else 0
        assert math.isclose(line[f'fft_coefficient__coeff_{k}__attr_"abs"'], abs(want), abs_tol=1e-12)
        if k < 3:
            angle = line[f'fft_coefficient__coeff_{k}__attr_"angle"']
            assert math.isclose(angle, np.degrees(np.angle(want)), abs_tol=1e-9)


def test_feature_counts(spark):
    df = frame(spark, [np.sin(np.arange(50) / 3)])
    keys = 2
    assert len(compact.compact_features(df, n_fft_coeffs=100).columns) == 447 + keys
    assert len(compact.compact_features(df, n_fft_coeffs=25).columns) == 147 + keys
    assert len(basic.minimal_features(df).columns) == 10 + 1
    assert len(efficient.efficient_features(df).columns) == 777 + keys
    assert len(efficient.efficient_features(df, fft_coefficients=25).columns) == 477 + keys
    assert len(efficient.efficient_features(df, comprehensive=True).columns) == 783 + keys
    assert len(signal.statistical_domain(df).columns) == 31 + keys
    assert len(signal.temporal_domain(df).columns) == 14 + keys
    assert len(drift.drift_features(df).columns) == 5 + keys


@pytest.mark.parametrize("name", EXTRACTORS)
def test_dirty_values_and_constants(spark, name):
    inf = float("inf")
    df = frame(spark, [[1, None, 3, 2], [float("nan"), 1, 2, 4], [inf, 1, -inf, 2], [5] * 20, [7], list(range(30))])
    params = {"step": "step"} if name in ("compact", "efficient", "comprehensive", "drift") else {}
    got = extract(df, name, **params).collect()
    assert {r.sequence_id for r in got} == set(range(6))
    assert all(r.value is not None and math.isfinite(r.value) for r in got)


def test_custom_extractor_function(spark):
    def spread(df, ids, channels):
        return df.groupBy(ids).agg({channels[0]: "max"}).withColumnRenamed(f"max({channels[0]})", "top")

    got = extract(frame(spark, [[1, 9, 2]]), spread).first()
    assert (got.feature, got.value) == ("top", 9.0)
    with pytest.raises(KeyError):
        extract(frame(spark, [[1]]), "absent")


# --- array features against plain definitions ---------------------------------------------------------


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(11)
    x = np.zeros(300)
    for i in range(1, 300):
        x[i] = 0.6 * x[i - 1] + rng.normal()
    return np.round(x, 3)


@pytest.fixture(scope="module")
def wide_noise(spark, noise):
    df = frame(spark, [noise])
    return wide(efficient.efficient_features(df, fft_coefficients=10, comprehensive=True, query=list(noise[40:50]), threshold=2.0))[0]


def test_autoregression_is_least_squares(noise, wide_noise):
    design = np.column_stack([np.ones(290), *[noise[10 - k : 300 - k] for k in range(1, 11)]])
    want = np.linalg.lstsq(design, noise[10:], rcond=None)[0]
    got = [wide_noise[f"ar_coefficient__coeff_{c}__k_10"] for c in range(11)]
    assert np.allclose(got, want)


def test_phrase_complexity_by_scan(noise, wide_noise):
    for bins in (2, 10):
        edges = np.linspace(noise.min(), noise.max(), bins + 1)[1:]
        symbols = [int((e_x > edges).sum()) for e_x in noise]
        phrases, now = set(), ()
        for s in symbols:
            now += (s,)
            if now not in phrases:
                phrases.add(now)
                now = ()
        assert math.isclose(wide_noise[f"lempel_ziv_complexity__bins_{bins}"], len(phrases) / len(noise))


def test_similar_windows_by_scan(noise, wide_noise):
    q = noise[40:50]
    q = (q - q.mean()) / q.std()
    hits = 0
    for i in range(len(noise) - 9):
        w = noise[i : i + 10]
        hits += np.linalg.norm((w - w.mean()) / w.std() - q) <= 2.0
    name = next(c for c in wide_noise if c.startswith("query_similarity_count"))
    assert wide_noise[name] == hits >= 1


def test_entropies_by_pairs(noise, wide_noise):
    def matches(m, radius, own):
        w = np.lib.stride_tricks.sliding_window_view(noise if own else noise[: len(noise) + 2 - 3], m)
        return np.array([(np.abs(w - v).max(axis=1) <= radius).sum() for v in w], float)

    radius = 0.2 * noise.std()
    b, a = (matches(2, radius, False) - 1).sum(), (matches(3, radius, True) - 1).sum()
    assert math.isclose(wide_noise["sample_entropy"], -math.log(a / b))

    def phi(m):
        c = matches(m, 0.3 * noise.std(), True) / (len(noise) - m + 1)
        return np.log(c).mean()

    assert math.isclose(wide_noise["approximate_entropy__m_2__r_0.3"], abs(phi(2) - phi(3)))


def test_unit_root_tells_noise_from_a_walk(spark, noise, wide_noise):
    walk = np.cumsum(noise)
    got = wide(efficient.efficient_features(frame(spark, [walk]), fft_coefficients=1))[0]
    name = 'augmented_dickey_fuller__attr_"pvalue"__autolag_"AIC"'
    assert wide_noise[name] < 0.01 < 0.1 < got[name]


def test_mass_quantiles_of_repeated_cents(spark):
    rng = np.random.default_rng(5)
    cents = [np.tile(rng.integers(1, 20_000, 40), 10) for _ in range(20)]
    got = wide(efficient.efficient_features(frame(spark, [c / 100 for c in cents]), fft_coefficients=1))
    for i, c in enumerate(cents):
        for tenths in (1, 2, 3, 4, 6, 7, 8, 9):
            # Whole numbers decide: each of the ten repeats holds a tenth of the mass.
            want = (np.argmax(10 * np.cumsum(c) >= tenths * c.sum()) + 1) / len(c)
            assert got[i][f"index_mass_quantile__q_{tenths / 10}"] == want == tenths / 10


def test_drift_polynomial_by_hand(spark, noise):
    got = wide(drift.drift_features(frame(spark, [noise])))[0]
    x, dx = noise[:-1], np.diff(noise)
    edges = np.quantile(x, np.linspace(0, 1, 31))
    place = np.clip(np.searchsorted(edges, x, side="left"), 1, 30)
    mx = [x[place == b].mean() for b in np.unique(place)]
    my = [dx[place == b].mean() for b in np.unique(place)]
    want = np.polyfit(mx, my, 3)
    assert np.allclose([got[f"friedrich_coefficients__coeff_{i}__m_3__r_30"] for i in range(4)], want)
    assert math.isclose(got["max_langevin_fixed_point__m_3__r_30"], np.roots(want).real.max(), rel_tol=1e-6)


def test_decay_lag(spark, noise):
    got = wide(signal.temporal_domain(frame(spark, [noise])))[0]["Autocorrelation"]
    d = noise - noise.mean()
    acf = np.correlate(d, d, "full")[len(d) - 1 :]
    assert got == np.flatnonzero(acf <= acf[0] / math.e)[0]


def test_other_names_of_the_sets(spark):
    df = frame(spark, [[1, 2, 3, 5]])
    for alias, name in (("polars_statistics", "statistics_sample"), ("numpy", "statistics_population"), ("tsfresh_minimal", "minimal")):
        assert extract(df, alias).exceptAll(extract(df, name)).isEmpty()
    few = extract(df, "numba_efficient", fft_coefficients=2)
    assert few.count() == 47 + 8
