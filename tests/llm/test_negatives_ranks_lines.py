"""Hard negatives, ranked search and line dedup against plain loops; nulls, empty and long texts, ties, repeated rows, empty tables."""

import math
import re

import numpy as np
import pytest

from tidemark.llm import hard_negatives as hn
from tidemark.llm import lexical_rank as lr
from tidemark.llm import line_dedup as ld

VECTORS = "vec_id long, label int, embedding array<float>, rank string, anchor_id string, v string"


# Hard negatives


def plain_negatives(rows, positives=5, negatives=10):
    own = {}
    for i, label, v, *_ in rows:
        if None not in (i, label, v) and v and all(x is not None and math.isfinite(x) for x in v):
            cell = (label, [math.floor(256 * float(np.float32(x))) for x in v])
            own[i] = min(own.get(i, cell), cell)
    out = []
    for a, (label, v) in own.items():
        if a % 100 == 0:
            score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in own.items() if i != a}
            order = sorted(score, key=lambda i: (-score[i], i))
            for p in [i for i in order if own[i][0] == label][:positives]:
                fits = [i for i in order if own[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
                out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fits[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("anchors, batch", [(4096, 10_000), (3, 64)])
def test_negatives_equal_brute_force(spark, anchors, batch):
    rng = np.random.default_rng(anchors)
    points = rng.integers(-3, 4, (900, 12)) / 4  # few values: many ties
    points[200:500] = points[0]  # a third of all rows is one vector
    rows = [(i - 100, int(rng.integers(0, 3)), p.tolist(), "r", "a", "v") for i, p in enumerate(points)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = hn.mine_hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), anchors=anchors).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found and sorted(map(tuple, found)) == plain_negatives(rows)


def test_vectors_that_take_no_part_or_tie(spark):
    rows = [
        (0, 1, [1.0, 0.5]), (0, 2, [9.0, 9.0]), (1, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 0, [0.5, 0.25]), (3, 0, [0.5, 0.25]), (4, None, [1.0, 1.0]),
        (None, 0, [0.5, 0.2]), (5, 0, None), (6, 0, []), (7, 0, [0.5, None]), (8, 0, [float("nan"), 1.0]), (9, 0, [float("inf"), 1.0]),
        (100, 7, [-1.0, -1.0]), (101, 7, [1.0, 1.0]), (200, 8, [0.0, 0.0]), (201, 8, [1.0, 0.0]),
    ]
    rows = [(*r, "x", "y", "z") for r in rows]
    df = spark.createDataFrame(rows, VECTORS)
    found = sorted(map(tuple, hn.mine_hard_negatives(df).collect()))
    assert found == plain_negatives(rows) and {r[3] for r in found if r[0] == 0} == {2, 3, 201}
    assert {r[4] for r in found if r[0] == 200} == {0}  # a positive score of zero takes scores of zero only
    empty = hn.mine_hard_negatives(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    mixed = spark.createDataFrame([*rows, (300, 1, [1.0, 0.5, 2.0], "", "", "")], VECTORS)
    assert sorted(map(tuple, hn.mine_hard_negatives(mixed).collect())) == found
    with pytest.raises(ValueError):
        hn.mine_hard_negatives(spark.createDataFrame([(0, 1, [1e30], "", "", ""), (1, 1, [1e30], "", "", "")], VECTORS))


def test_scan_drops_candidates_before_the_last_dimension():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(4000, 32)) * np.linspace(4, 0.1, 32)
    points = np.floor(256 * points)
    block = hn.Columns(np.arange(4000), np.zeros(4000, int), np.ascontiguousarray(points.T), points.min(0), points.max(0))
    best, seen = hn.Best(5, float), []

    def useful(low, high):
        seen.append(len(low))
        return high >= best.threshold(low)

    places, scores = block.scan(points[0], np.ones(4000, bool), useful)
    exact = points @ points[0]
    assert set(np.argsort(-exact)[:5]) <= set(places) and np.array_equal(scores, exact[places])
    assert seen[-1] < 0.3 * 4000 and len(places) < 40


# Ranked search


def plain_ranks(docs, items, k=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, w) for d, w in held if w]
    n_docs, length = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    whole = {}
    for i, t in items:
        whole.setdefault(i, []).extend(terms(t))
    out = []
    for i, asked in whole.items():
        scored = []
        for d, w in held:
            m = 75 + 25 * len(w) * n_docs // length
            s = sum(weight.get(t, 0) * (10**9 * w.count(t) // (1000 * w.count(t) + 12 * m)) for t in asked)
            scored.append((-s, d is None, d or 0, d))
        out += [(i, n + 1, d, -s) for n, (s, _, _, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
    return out


@pytest.mark.parametrize("part_bytes, batch", [(8 << 20, 10_000), (300, 50)])
def test_ranks_equal_brute_force(spark, part_bytes, batch):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(150)] + ["Ünï", "ünï", "É", "a1b2", "日本", "A"]
    chance = 1 / np.arange(1, len(words) + 1)
    draw = lambda n: " ".join(rng.choice(words, n, p=chance / chance.sum()))
    docs = [(int(i), draw(int(rng.integers(0, 60)))) for i in range(400)]
    docs += [(900, None), (901, ""), (902, "--, ."), (903, draw(30_000)), (None, docs[3][1]), (None, docs[3][1]), (3, docs[3][1])]
    docs += [(1000 + i, docs[5][1]) for i in range(200)]  # a third of all documents is one text
    items = [(i, draw(int(rng.integers(1, 12)))) for i in range(15)] + [(50, " ".join(words)), (51, None), (52, "unknown"), (53, ""), (7, "w3 w3"), (None, "w1/w2")]
    table = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in docs], "doc_id long, text string, score string, n int, item_id string").repartition(4)
    asked = spark.createDataFrame(items, "item_id int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = lr.rank_documents(table, asked, part_bytes=part_bytes).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, found), key=order) == sorted(plain_ranks(docs, items), key=order)


def test_ranks_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lr.rank_documents(docs, items).count() == 0
    assert lr.rank_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_masks_that_cannot_enter_are_not_evaluated():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    terms = [np.unique(np.append(rng.integers(0, 40, 12), [0])) for _ in range(5000)]
    tfs = [np.ones(len(t), int) for t in terms]
    columns = [pa.array(np.arange(5000)), pa.array(np.full(5000, 12)), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
    block = lr.Block(pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "tfs"]), (5000, 60_000))
    ranking, own = lr.Ranking(20), np.array([0, 3, 9, 20])
    evaluated = block.rank(ranking, own, np.array([1, 900, 1000, 1100]), np.zeros(40, np.int64))
    held = sum(int((t == x).any()) for t in terms for x in own[:1])
    assert held == 5000 and 20 <= evaluated < 500


# Line dedup

LINES = [
    (4, "Alpha beta gamma\nshort\n\nonly here once\nALPHA BETA GAMMA\n"), (2, " alpha beta gamma\t\nshort\nAlpha Beta Gamma"), (9, "alpha beta gamma"),
    (None, "alpha beta gamma\nshort\nno id at all"), (None, "no id at all\nother line here"), (5, None), (6, ""), (7, "\n\n"), (8, "ÄÖÜ ÄÖÜ ÄÖÜ\näöü äöü äöü"),
    (10, "äöü äöü äöü\nÄÖÜ ÄÖÜ ÄÖÜ\n  123456789  \n0123456789"), (11, "0123456789\n123456789"), (12, "word " * 40_000 + "\nalpha beta gamma"),
    (2, " alpha beta gamma\t\nshort\nAlpha Beta Gamma"), (2, "another text of two\nonly here once"), (13, "ǅabcdefghij\x85\nǆabcdefghij\xa0"),
]


def plain_lines(docs, least=10):
    blank = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(blank))
    rank = lambda d: (d is None, d or 0)
    first = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                first[key(line)] = min(first.get(key(line), rank(d)), rank(d))
    out = []
    for d, t in docs:
        own = (t or "").split("\n")
        kept = [i for i, line in enumerate(own) if len(key(line)) < least or first[key(line)] == rank(d)]
        out.append((d, len(own), len(own) - len(kept), "\n".join(own[i] for i in kept), kept))
    return out


@pytest.mark.parametrize("hot", [10_000, 2])
def test_lines_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(ld, "HOT_ROWS", hot)  # from 2 lines on every repeated key goes the way of hot ones
    rows = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in LINES], "doc_id long, text string, keep string, gone string, first int").repartition(3)
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    found = ld.kept_lines(rows)
    assert found.columns == ["doc_id", "gone", "first", "text", "n_lines", "n_dropped", "keep"]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text, [i for k in r.keep for i in range(k.first, k.last + 1)]) for r in found.collect()]
    assert sorted(got, key=order) == sorted(plain_lines(LINES), key=order)
    maps = ld.keep_bitmaps(rows)
    assert "text" not in maps.columns and sorted(r.n_dropped for r in maps.collect()) == sorted(x[2] for x in got)


def test_lines_of_an_empty_table(spark):
    assert ld.kept_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_keys_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ld, "HOT_ROWS", 5)
    monkeypatch.setattr(ld, "HOT_SHARE", 8)
    docs = [(i, "a line that all hold\n" + f"a line that few hold {i % 50}") for i in range(200)]
    lines = ld._keyed_lines(spark.createDataFrame(docs, "doc_id long, text string"), "text", "doc_id", 10)
    hot = ld._hot_keys(lines).collect()
    assert [r["first"] for r in hot] == [0]
