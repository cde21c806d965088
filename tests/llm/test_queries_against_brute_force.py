"""Registered queries held against plain Python over whole small tables, and the SQL where there is some."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from oracle import connect, differences

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
NAMES = {int(re.match(r"op(\d+)_", n)[1]): n for n in QUERIES if re.match(r"op\d+_", n)}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, number):
    return QUERIES[NAMES[number]](spark, SF).collect()


def test_all_operators_and_the_pipeline_are_registered():
    assert sorted(NAMES) == list(range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("number", [5, 7, 8, 9, 11, 12, 13])
def test_equals_sql(spark, number):
    assert differences(connect(SF), QUERIES[NAMES[number]](spark, SF), ORACLES[NAMES[number]]) == []


def test_simhash(spark, docs):
    found = rows(spark, 2)
    fps = {}
    for doc_id, text in docs.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps[doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert {r.doc_id: r.fingerprint for r in found} == {k: f"{v:016x}" for k, v in fps.items()}
    assert {r.doc_id: r.component_id for r in found} == reachable(fps, 3)


def reachable(fps, bits):
    label = {k: k for k in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if label[b] < label[a] and (fps[a] ^ fps[b]).bit_count() <= bits:
                    label[a], changed = label[b], True
    return label


def test_token_shards(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for doc_id in sorted(docs):
        ids = np.array([*tokenizer.encode(docs[doc_id], add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows(spark, 3))) == want


def test_secret_scan(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    kinds = (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    )
    some = 0
    for r in QUERIES[NAMES[4]](spark, "/root/testdata/sf0.01").collect():
        spans = sorted(
            (m.start(), i, m.end())
            for i, (_, pattern, group, least) in enumerate(kinds)
            for m in re.finditer(pattern, docs[r.doc_id])
            if len(m[group]) >= least
        )
        said = [f"{kinds[i][0]}:{a}:{b}" for a, i, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(",") if r.spans else [])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(i == k for _, i, _ in spans) for k in range(3)]
        some += len(spans)
    assert some


def test_main_text(spark):
    """The blocks from the heading to the footer, less what the page names as an advert; pages as they are, and with all marks
    of the article taken away."""
    import html

    from tidemark.llm.html_text import main_text

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in rows(spark, 10):
        body = pages[r.page_id][pages[r.page_id].index("<h1>") :].split("<footer>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        want = "\n\n".join(b for b in blocks if b)
        assert r.text == want and r.n_chars == len(want)
        assert main_text(pages[r.page_id].replace("<article>", "<div>").replace("</article>", "</div>")) == want
        assert main_text(pages[r.page_id].replace("<article>", "").replace("</article>", "")) == want


def test_decontamination(spark, docs):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    # Verbatim and nearly verbatim: nine of ten of an item's word triples.
    want = {(d, i) for d, t in docs.items() for g in [grams(words(t))] for i, w in items.items() if len(g & grams(w)) >= 0.9 * len(grams(w))}
    found = {(r.doc_id, r.item_id) for r in rows(spark, 1)}
    assert want and want <= found
    assert all(len(grams(words(docs[d])) & grams(items[i])) >= 0.3 * len(grams(items[i])) for d, i in found)


def test_toxicity_holds_on_rows_it_never_saw(spark):
    scored = {r.doc_id: r for r in QUERIES[NAMES[6]](spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in scored.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.values())
    held = [(scored[d].score, y) for d, y in labels.items() if scored[d].held_out and y is not None]
    toxic, clean = [s for s, y in held if y], [s for s, y in held if not y]
    assert toxic and sum(a > b for a in toxic for b in clean) >= 0.85 * len(toxic) * len(clean)
