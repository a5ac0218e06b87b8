"""One query per corpus operator, over the whole table it is meant for."""

from __future__ import annotations

from typing import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecfold.llm import language_model, mixing, packing, quality_rules, rule_ensemble, secret_scan, simhash, suffix_dedup, topk, toxicity
from vecfold.llm import prefix_trie, url_filter, vector_codes
from vecfold.llm.texts import id_remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SECRET_VOCABULARY = "byte_bpe_50k.tiktoken"
PACKING_TOKENIZER = "word_bpe_49k.json"
LABEL_FOLDS, HELD_OUT_FOLD = 5, 0


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out() -> Column:
    return id_remainder(LABEL_FOLDS) == HELD_OUT_FOLD


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.filter(~held_out()).select("doc_id", F.col(label).alias("label"))


def toxic_model(spark: SparkSession, sf_dir: str, docs: DataFrame):
    return toxicity.fit(docs, learnable(table(spark, sf_dir, "labels"), "toxic"))


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = toxicity.score(toxic_model(spark, sf_dir, docs))
    scored = docs.select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query()
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), public_tokenizers.path(SECRET_VOCABULARY))


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_TOKENIZER))


REPEATS_SQL = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunks AS (
    SELECT doc_id, 1000 * c AS base, substr(h, 2000 * c + 1, 2098) AS part
    FROM texts, range(0, len(h) // 2000 + 1) AS r(c)),
strings AS (
    SELECT doc_id, base + i AS i, substr(part, 2 * i + 1, 100) AS g
    FROM chunks, range(0, least(1000, len(part) // 2 - 49)) AS r(i)),
first_ids AS (SELECT g, min(doc_id) AS low FROM strings GROUP BY g HAVING count(DISTINCT doc_id) > 1),
hits AS (
    SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true)::INT AS fresh
    FROM strings JOIN first_ids USING (g) WHERE doc_id > low),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM hits),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, span),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM spans),
kept AS (
    SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last_end,
           string_agg(substr(h, 2 * kept_from::BIGINT + 1, 2 * (a - kept_from)::BIGINT), '' ORDER BY a) AS kept
    FROM cuts JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last_end, 0)::BIGINT + 1))) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)"""


@query(REPEATS_SQL)
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return quality_rules.judge(docs, quality_rules.fit_ratios(docs, trusted))


TOP_K_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


@query(TOP_K_SQL)
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)


MIXING_SQL = r"""
WITH rows AS (
    SELECT doc_id, source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
    FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s
    FROM rows GROUP BY source),
weighted AS (
    SELECT *, CASE s % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS top FROM sources),
levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(top) OVER before, 0))::DOUBLE
              / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
    FROM weighted
    WINDOW before AS (ORDER BY top::DOUBLE / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (
    SELECT source, s, source_size,
           least(top::DOUBLE, max(CASE WHEN level <= top::DOUBLE / w THEN level END) OVER () * w) AS target
    FROM levels),
shares AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216 + 0.5) ELSE 0 END::BIGINT AS e
    FROM aims),
summed AS (
    SELECT doc_id, size, source_size, target, e, s, (s + 1) * 2654435761 + 97 AS start,
           sum(e) OVER (PARTITION BY s ORDER BY size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM rows JOIN shares ON rows.source IS NOT DISTINCT FROM shares.source),
tried AS (
    SELECT s, k, abs(sum(((upto + (start + k * 10368889) % 16777216) // 16777216
                          - (upto - e + (start + k * 10368889) % 16777216) // 16777216) * size) - first(target)) AS off
    FROM summed, range(32) AS r(k) GROUP BY s, k),
best AS (SELECT s, k FROM tried QUALIFY row_number() OVER (PARTITION BY s ORDER BY off, k) = 1),
placed AS (
    SELECT doc_id, size, source_size, target, e, upto + (start + k * 10368889) % 16777216 AS upto
    FROM summed JOIN best USING (s))
SELECT doc_id, size, source_size, target, ((upto // 16777216 - (upto - e) // 16777216) * size)::BIGINT AS taken
FROM placed"""


@query(MIXING_SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words().alias("size"))
    found = mixing.mix(docs)
    return found.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = rule_ensemble.fit(docs, learnable(table(spark, sf_dir, "labels"), "quality"))
    known = rule_ensemble.statistics(docs.select("doc_id", "text", held_out().alias("held_out")), "doc_id", "held_out")
    scored = known.select("doc_id", "held_out", model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query()
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


@query()
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.fit(url_filter.rule_labelled(pages))
    found = url_filter.judge(pages, model)
    return found.select("page_id", "host", "path", "rule", "verdict", "block_probability")


@query()
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query()
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    digest = F.lit(vector_codes.books_digest(books))
    return coded.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
