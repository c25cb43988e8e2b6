"""The queries op1 to op10 on the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sylvan.llm import bpe, embedding_dedup, exact_dedup, html_extract, jaccard_join, packing, pii, quality, suffix_dedup, toxicity
from sylvan.llm.common import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_spans(read(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(read(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(read(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_documents(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_bpe, op3_quality, op4_packing, op5_exact_dedup, op6_suffix_dedup, op7_embedding_dedup, op8_toxicity, op9_html, op10_jaccard_join)}

ORACLE = {
    "op5_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op6_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT doc_id, p, x[2 * p + 1 : 2 * p + 100] AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS p FROM d)),
        hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE m < doc_id),
        cut AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true) AS new FROM hit),
        run AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM cut) GROUP BY doc_id, r),
        piece AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM run UNION ALL
                  SELECT doc_id, coalesce(max(b), 0), max(len(x)) // 2 FROM d LEFT JOIN run USING (doc_id) GROUP BY doc_id),
        kept AS (SELECT doc_id, string_agg(x[2 * f + 1 : 2 * t], '' ORDER BY f, t) AS k FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
        n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM run GROUP BY doc_id)
        SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
        FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
    "op7_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
            AND len(list_filter(embedding, lambda c: c <> 0)) > 0 AS good FROM embeddings),
        g AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE good),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)
    """,
    "op10_jaccard_join": r"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM t WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM t JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
}
