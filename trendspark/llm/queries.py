"""One registered query for each operator, over its whole table, and the SQL that checks it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm import bpe_codec, cover_tree, fill_middle, language_id, license_scan, mixing, ngram_join, quality_rules, simhash, spelling, token_counts, token_frames, toxicity
from trendspark.llm.common import id_crc, table

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _on_workers(spark: SparkSession) -> None:
    """Python workers find this package also where the driver was started from another folder."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    _on_workers(spark)
    return table(spark, sf_dir, "documents")


def op1_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    _on_workers(spark)
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(_documents(spark, sf_dir)).drop("detections")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality_rules.judged(docs, quality_rules.rules_from(docs, table(spark, sf_dir, "labels")))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(_documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir))


def op6_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.read_frames(token_frames.write_frames(_documents(spark, sf_dir)), ids_too=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), keep=id_crc() % 3 != 1)
    held_out = F.coalesce(id_crc() % 3 == 1, F.lit(False)).alias("held_out")
    return toxicity.scored(docs, model).select("doc_id", held_out, "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language_id.learn(docs, keep=id_crc() % 5 != 0)
    held_out = F.coalesce(id_crc() % 5 == 0, F.lit(False)).alias("held_out")
    return language_id.predicted(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(_documents(spark, sf_dir))


def op11_simhash_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_documents(spark, sf_dir))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    _on_workers(spark)
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_cover_tree_search, op2_license_scan, op3_quality_rules, op4_ngram_jaccard_join, op5_token_counts, op6_token_frames, op7_toxicity, op8_language_id, op9_source_mixing, op10_bpe_codec, op11_simhash_vantage, op12_fill_middle, op13_spelling_variants, pipeline)}

ORACLE = {
    "op1_cover_tree_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
            FROM v q JOIN v ON v.vec_id <> q.vec_id
            WHERE q.vec_id % 50 = 0)
        SELECT query_id, rank, vec_id, score
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        WHERE rank <= 5""",
    "op4_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
            FROM w),
        t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        l AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        r(a, b) AS (
            SELECT doc_id, doc_id FROM s
            UNION
            SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
        FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id""",
    "op9_source_mixing": """
        WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        r AS (SELECT source, (SELECT sum(n) FROM n) * 1.0 / (SELECT count(*) FROM n) / n AS rate FROM n),
        u AS (
            SELECT d.*, r.rate, coalesce(CAST(d.doc_id AS VARCHAR), 'text ' || md5(coalesce(d.text, ''))) AS key
            FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
        c AS (
            SELECT *, CAST(len(list_filter(range(0, 400), lambda k:
                       list_sum(list_transform(range(0, k + 1), lambda j: exp(-rate + j * ln(rate) - lgamma(j + 1))))
                       <= CAST('0x' || substr(md5('17:' || key), 1, 13) AS BIGINT) / 4503599627370496.0)) AS INTEGER) AS n_copies
            FROM u),
        x AS (SELECT *, unnest(range(0, n_copies)) AS k FROM c WHERE n_copies > 0)
        SELECT doc_id, text, lang, source, n_chars, n_copies, CAST(k AS INTEGER) AS copy,
               CAST('0x' || substr(md5('17 place:' || key || ':' || CAST(k AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS place
        FROM x""",
    "op12_fill_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                   sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
            FROM documents),
        c AS (
            SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
                        WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM d),
        p AS (
            SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
                   array_to_string(u[greatest(a, b) + 1:], '') AS suffix
            FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
}
