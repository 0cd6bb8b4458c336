"""Queries opN_<name> of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from veilframe.llm import hmm
from veilframe.llm.chains import passages
from veilframe.llm.codebooks import compress
from veilframe.llm.dac import token_files
from veilframe.llm.decontam import benchmark_hits
from veilframe.llm.hard_negatives import hard_negatives
from veilframe.llm.jaccard import near_duplicates
from veilframe.llm.langid import identify
from veilframe.llm.minhash import deduplicated
from veilframe.llm.packing import pack
from veilframe.llm.pages import main_text
from veilframe.llm.png import media_features
from veilframe.llm.token_counts import token_counts
from veilframe.llm.tokens import WORD_BPE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op2_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), WORD_BPE, budget=2048)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"), WORD_BPE, end_id=1)


def op4_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), WORD_BPE, capacity=2048, end_id=0)


def op6_hidden_markov_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, Jaccard of 0.9 or more."""
    return near_duplicates(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(_table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hits.drop("spans")


def op10_consensus_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op11_vantage_point_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of vec_ids divisible by 7 are moved on by one first; anchors are vec_ids divisible by 100."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard of 0.85 or more."""
    return deduplicated(_table(spark, sf_dir, "documents"), n=5, num=85, den=100)


def op13_vector_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


_OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))),
hits AS (SELECT r, i, k, item FROM dw JOIN bw USING (k, win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


_OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT u AS node, v AS other FROM l UNION SELECT r.node, l.v FROM r JOIN l ON r.other = l.u),
k AS (SELECT node, min(other) AS least FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k ON node = doc_id
"""

_USABLE = """e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

_OP11_SQL = f"""
WITH {_USABLE.format(scale=256)},
r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM e WHERE label IS NOT NULL),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM r a, r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS p FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, p AS positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * p <= 100 * score AND 100 * score <= 90 * p
QUALIFY rank <= 10
"""


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round as two tables: each part's nearest entry, then the moved entries."""
    steps = [
        _USABLE.format(scale=4096),
        f"""x AS MATERIALIZED (SELECT vec_id, label, part, list_transform(v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}], lambda t: CAST(t AS BIGINT)) AS c
  FROM e, (SELECT unnest(range(0, {parts})) AS part))""",
        f"""b0 AS MATERIALIZED (SELECT part, entry, c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e QUALIFY entry < {entries}) USING (vec_id))""",
    ]
    far = "list_sum(list_transform(list_zip(x.c, b.c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    for k in range(rounds + 1):
        steps.append(
            f"""n{k} AS MATERIALIZED (SELECT vec_id, label, part, min(({far}, entry)) AS m, any_value(x.c) AS c FROM x JOIN b{k} b USING (part) GROUP BY vec_id, label, part)"""
        )
        if k < rounds:
            steps.append(
                f"""s{k} AS MATERIALIZED (SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS c FROM (
  SELECT part, m[2] AS entry, i, sum(t) AS total, count(*) AS n FROM (SELECT part, m, unnest(c) AS t, unnest(range(len(c))) AS i FROM n{k}) GROUP BY ALL) GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(s.c, b.c) AS c FROM b{k} b LEFT JOIN s{k} s USING (part, entry))"""
            )
    return f"""WITH {", ".join(steps)},
f AS (SELECT vec_id, label, string_agg(printf('%02x', m[2]), '' ORDER BY part) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM n{rounds} GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f, h"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_string_kernel_language, op2_prefix_token_counts, op3_token_files, op4_collinear_passages,
        op5_best_fit_packing, op6_hidden_markov_score, op7_ngram_jaccard_join, op8_media_columns,
        op9_benchmark_decontamination, op10_consensus_html_text, op11_vantage_point_negatives, op12_tensored_minhash,
        op13_vector_codebooks,
    )
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    own = {
        "op9_benchmark_decontamination": _OP9_SQL, "op11_vantage_point_negatives": _OP11_SQL, "op12_tensored_minhash": _OP12_SQL,
        "op13_vector_codebooks": _op13_sql(), "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {name: sql for name, sql in own.items() if sql}
