"""Features of long sequences that need more than sums over blocks: equal to the forms for one array."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.functions.matches import match_shares, matches
from tidemark.functions.phrases import PhraseParse
from tidemark.functions.range_order import RangeOrder
from tidemark.operators.features import entropies, phrases, ridges, spectrum, unit_root
from tidemark.operators.features.rows import sequence_rows

SHARES = (0.1, 0.3, 0.5, 0.7, 0.9)
BINS = (2, 3, 5, 10, 100)


def series():
    rng = np.random.default_rng(3)
    noise = rng.normal(size=3000)
    return {
        0: np.round(np.cumsum(rng.normal(size=700)) * 0.3 + rng.normal(size=700), 2),
        1: rng.normal(size=2999) * 3 + 1e3,
        2: np.repeat(rng.integers(0, 3, 600), 8)[:4097].astype(float),
        3: np.where(np.arange(1500) % 3 > 0, 0.0, noise[:1500]),  # two thirds of all values are one
        4: np.sin(np.arange(1031) / 7) + 0.05 * noise[:1031],
        5: np.full(900, 2.5),
        6: np.append(noise[:800], np.nan),
    }


@pytest.fixture(scope="module")
def both(spark):
    """Rows in blocks of 256, and the same sequences as arrays."""
    data = series()
    df = spark.createDataFrame([(i, t, float(v)) for i, x in data.items() for t, v in enumerate(x)], "sequence_id long, step int, v double")
    settings = {"spark.tidemark.maxGroupRows": "600", "spark.tidemark.blockRows": "256"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    rows = sequence_rows(df.repartition(5), channels=["v"], halo=64)
    for k in settings:
        spark.conf.unset(k)
    assert rows.split and rows.block_rows == 256
    rows = rows.with_stats({"mu": F.avg("x"), "sd": F.stddev_pop("x"), "lo": F.min("x"), "hi": F.max("x")})
    return rows, spark.createDataFrame([(i, x.tolist()) for i, x in data.items()], "sequence_id long, xs array<double>")


TABLES = {
    "spectrum": (spectrum.spectrum_moment_table, ["moments"], [lambda xs: K.spectrum_moments(xs)]),
    "phrases": (lambda r: phrases.phrase_table(r, BINS), ["complexities"], [lambda xs: K.phrase_complexity(xs, BINS)]),
    "two symbols": (lambda r: phrases.threshold_phrase_table(r, 0.5), ["complexity"], [lambda xs: F.get(K.threshold_complexity(xs, 0.5), F.lit(0))]),
    "unit root": (unit_root.unit_root_table, ["root"], [lambda xs: K.unit_root(xs)]),
    "ridges": (lambda r: ridges.ridge_table(r, (1, 5)), ["ridges"], [lambda xs: K.wavelet_peaks(xs, (1, 5))]),
    "entropies": (
        lambda r: entropies.entropy_table(r, SHARES, tile=64), ["sample", "approximate"],
        [lambda xs: K.sample_entropy(xs), lambda xs: K.approximate_entropy(xs, 2, SHARES)],
    ),
}


@pytest.mark.parametrize("name", TABLES)
def test_blocks_equal_arrays(both, name):
    rows, arrays = both
    table, columns, forms = TABLES[name]
    got = {r["sequence_id"]: r for r in table(rows).collect()}
    for r in arrays.select("sequence_id", *[f(F.col("xs")).alias(c) for f, c in zip(forms, columns)]).collect():
        for c in columns:
            want = np.atleast_1d(np.array(r[c], float))
            if r["sequence_id"] in got:
                found = np.atleast_1d(np.array(got[r["sequence_id"]][c], float))
                assert np.allclose(found, want, rtol=1e-7, atol=1e-9, equal_nan=True), (name, r["sequence_id"], c)
            else:
                assert np.isnan(want).all()


def test_transform_of_many_groups_of_columns(both):
    """A long sequence whose matrix is dealt to several column and row groups, of a length that is a prime."""
    n, cells = 4099, 1 << 10
    plan = spectrum._Plan(n, cells)
    assert plan.wide // plan.columns > 1 and plan.high // plan.rows > 1
    assert plan.high * plan.wide == plan.size >= 2 * n - 1


def test_counts_and_order_in_stretches():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 500):
        x = rng.integers(0, 30, n).astype(float)
        order = RangeOrder(x)
        a = rng.integers(0, n, 200)
        b = a + 1 + (rng.random(200) * (n - a)).astype(int)
        v = rng.integers(-2, 33, 200).astype(float)
        k = (rng.random(200) * (b - a)).astype(int)
        assert order.count_less(a, b, v).tolist() == [int((x[i:j] < w).sum()) for i, j, w in zip(a, b, v)]
        assert order.smallest(a, b, k).tolist() == [sorted(x[i:j])[m] for i, j, m in zip(a, b, k)]


def test_phrases_in_parts():
    rng = np.random.default_rng(5)
    symbols = rng.integers(0, 3, 2000).astype(np.uint8).tobytes()
    seen, at, length = set(), 0, 1
    while at + length <= len(symbols):
        if symbols[at : at + length] in seen:
            length += 1
        else:
            seen.add(symbols[at : at + length])
            at, length = at + length, 1
    parse = PhraseParse(3)
    for i in range(0, 2000, 37):
        parse.feed(symbols[i : i + 37])
    assert parse.count == PhraseParse(3).feed(symbols).count == len(seen)


def test_matches_with_weights_and_ties():
    rng = np.random.default_rng(6)
    own, others = (rng.integers(0, 8, (3, n)) / 10 for n in (90, 130))
    weights = rng.integers(1, 2000, 130)
    two, three = matches(own, others, weights, 0.2)
    near = np.abs(own[:, :, None] - others[:, None, :]) <= 0.2
    assert two.tolist() == ((near[0] & near[1]) @ weights).tolist()
    assert three.tolist() == (near.all(0) @ weights).tolist()
    x = rng.integers(0, 6, 300) / 10
    for m in (2, 3):
        parts = np.lib.stride_tricks.sliding_window_view(x, m)
        assert match_shares(x, m, 0.1).tolist() == [(np.abs(parts - p).max(axis=1) <= 0.1).sum() for p in parts]


def test_ridge_lines_equal_plain_ones():
    rng = np.random.default_rng(8)
    for n in (1, 3, 5, 12):
        for _ in range(30):
            tops = [np.unique(rng.integers(0, 60, rng.integers(0, 25))) for _ in range(n)]
            lines = []
            for level in range(n - 1, -1, -1):
                ends = [line["at"] for line in lines]
                for p in tops[level].tolist():
                    far = [abs(e - p) for e in ends]
                    if far and min(far) <= (level + 1) / 4:
                        line = lines[far.index(min(far))]
                        line.update(at=p, gap=-1, level=level, length=line["length"] + 1)
                    else:
                        lines.append({"at": p, "gap": -1, "level": level, "length": 1})
                for line in lines:
                    line["gap"] += 1
                    if line["gap"] > 1:
                        line["at"] = -(10**9)
            want = sorted((x["at"], x["level"], x["length"]) for x in lines if x["at"] >= 0)
            assert sorted(zip(*(v.tolist() for v in K.ridge_lines(tops, n)))) == want


def test_noise_that_lies_between_two_values(spark, both):
    """The lines that two counts do not settle are settled by the values around."""
    from tidemark.operators.features.ridges import _between

    x = np.random.default_rng(9).normal(size=1000)
    start, stop, k, part = 100, 900, 80, 0.25
    ordered = np.sort(x[start:stop])
    quantile = ordered[k] + (ordered[k + 1] - ordered[k]) * part
    v = float(-(ordered[k] + 0.5 * (ordered[k + 1] - ordered[k])))
    blocks = spark.createDataFrame([(1, "v", b, x[256 * b : 256 * b + 256].tolist()) for b in range(4)], "sequence_id long, channel string, block long, xs array<double>")
    less, upto = int((x[start:stop] < -v).sum()), int((x[start:stop] <= v).sum())
    lines = spark.createDataFrame([(1, "v", 5, 7, v, start, stop, less, upto, k, part)], "sequence_id long, channel string, scale int, line long, v double, start long, stop long, less long, upto long, k long, part double")
    found = _between(lines, blocks, ["sequence_id", "channel"], 256).first()
    assert less == k + 1 and found["stands"] == int(v >= abs(quantile)) and math.isfinite(v)
