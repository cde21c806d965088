"""Registered queries of the operators, over whole tables, and the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontamination import find_contamination
from tidemark.llm.hard_negatives import mine_hard_negatives
from tidemark.llm.html_text import extract_main_text
from tidemark.llm.lexical_rank import rank_documents
from tidemark.llm.line_dedup import kept_lines
from tidemark.llm.mixing import mix_sources
from tidemark.llm.secret_scan import scan_secrets
from tidemark.llm.sharding import assign_shards
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.token_shards import new_shard_path, read_token_shards, write_token_shards
from tidemark.llm.toxicity import held_out, score_toxicity, train_toxicity
from tidemark.llm.url_filters import judge_urls
from tidemark.plans.registry import table

from tidemark.llm.vector_search import search_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The entries that the url query judges by.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


@query(
    "op5_mix_sources",
    rf"""
    WITH d AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size,
                      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS k
               FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
                 2.0::DOUBLE * source_size AS cap FROM s),
    l AS (SELECT *, cap / weight AS full_at,
                 (1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER f - cap)) / (sum(weight) OVER () - (sum(weight) OVER f - weight)) AS level
          FROM w WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT source, source_size,
                 least(cap, weight * (SELECT arg_min(level, full_at) FROM l WHERE level <= full_at)) AS target FROM l),
    e AS (SELECT *, floor(target + 0.5)::BIGINT AS budget,
                 CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
    p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest,
                 sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS UNBOUNDED PRECEDING) - d.size AS before
          FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, size, source_size, target,
           (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p
    """,
)
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def _draw(shards: int) -> str:
    return f"""arg_min(s, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13))::BIGINT + 0.5::DOUBLE)
                / 4503599627370496.0::DOUBLE)) FILTER (s < {shards})::INTEGER"""


@query(
    "op7_rendezvous_shards",
    f"""
    WITH tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
                             ORDER BY i) AS t FROM range(256) AS r(i)),
    d AS (SELECT row_number() OVER () AS row_id, doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
                 xor(4294967295::BIGINT, list_reduce(
                     list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT),
                     lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT)) AS text_crc32
          FROM documents, tab),
    x AS (SELECT row_id, {_draw(40)} AS shard, {_draw(41)} AS grown_shard FROM d, range(41) AS r(s) GROUP BY row_id)
    SELECT d.doc_id, d.size, d.text_crc32, 'key' AS law, x.shard, x.grown_shard,
           row_number() OVER (PARTITION BY x.shard ORDER BY ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT) - 1 AS slot
    FROM d JOIN x USING (row_id)
    """,
)
def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _rule_sql() -> str:
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return f"(VALUES {rows}) AS r(verdict, host, path)"


@query(
    "op9_url_filters",
    rf"""
    WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
    p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
    m AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
                 row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host) DESC NULLS LAST, length(r.path) DESC) AS n
          FROM p LEFT JOIN {_rule_sql()} ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
    """,
)
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op2_simhash_anchors")
def op2_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, max_bits=3, columns=["doc_id"])


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query("op10_html_main_text")
def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")


@query("op3_token_shards")
def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_shard_path(spark)
    write_token_shards(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_shards(spark, path)


@query("op6_toxicity_cnn")
def op6_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(scored["doc_id"]).alias("held_out"), "score", "predicted", "threshold", "rejected")


@query(
    "op8_vector_search",
    """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    d AS (SELECT q.vec_id AS query_id, c.vec_id,
                 sqrt(list_reduce(list_transform(list_zip(c.v, q.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
          FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INTEGER AS rank FROM d)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
)
def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_vectors(table(spark, sf_dir, "embeddings"), k=10, every=100)


@query("op1_latent_decontamination")
def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.cosine", "m.lcs", "m.answer")


@query(
    "op11_hard_negatives",
    """
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                 list_reduce(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]), lambda x, y: x + y)::BIGINT AS score
          FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
     AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
    QUALIFY row_number() OVER w <= 10
    """,
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved))


def _terms_sql(source: str, key: str) -> str:
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, unnest(regexp_extract_all({lowered}, '{pattern}')) AS term FROM {source}"


@query(
    "op12_lexical_rank",
    f"""
    WITH w AS ({_terms_sql("documents", "doc_id")}),
    tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM w GROUP BY ALL),
    d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
    c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM d),
    m AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // length AS m FROM d, c),
    q AS ({_terms_sql("benchmark", "item_id")}),
    qf AS (SELECT item_id, term, count(*)::BIGINT AS times FROM q GROUP BY ALL),
    df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
    wt AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, c),
    s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
          FROM qf JOIN wt USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
    SELECT item_id, (row_number() OVER r)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
    WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER r <= 20
    """,
)
def op12_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rank_documents(docs, table(spark, sf_dir, "benchmark"), k=20)


@query(
    "op13_line_dedup",
    """
    WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM t),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    m AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
    x AS (SELECT k.*, coalesce(k.doc_id > m.first, false) AS gone FROM k LEFT JOIN m USING (key))
    SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM x GROUP BY doc_id
    """,
)
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return kept_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
