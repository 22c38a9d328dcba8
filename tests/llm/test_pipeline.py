"""The pipeline's stages on a small table, each held against what it should keep."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from trendspark.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = []
    for name, stage in P.STAGES:
        out = written(stage(spark, kept[-1] if kept else docs, SF), name)
        if stage is not P.encode:
            assert out.columns == docs.columns
        kept.append(out)
    language, toxic, near, mixed, ids = kept
    assert language.count() == docs.where("text rlike '\\\\p{L}'").count()
    assert toxic.join(language, "doc_id", "left_anti").count() == 0 and toxic.count() >= 0.8 * language.count()
    assert near.groupBy("doc_id").count().where("count > 1").isEmpty() and near.join(toxic, "doc_id", "left_anti").count() == 0
    assert near.select("text").distinct().count() == near.count() == near.where(F.length("text") > 0).count()
    assert mixed.join(near, "doc_id", "left_anti").count() == 0
    want = Counter(map(tuple, mixed.select("doc_id", F.sha2("text", 256)).collect()))
    assert Counter(map(tuple, ids.select("doc_id", "decoded_sha256").collect())) == want


ODD = "doc_id long, text string, lang string, source string, n_chars long, near_key string, copy int, lang_score string"


def test_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns whose names the stages use themselves."""
    real = [(r.doc_id, r.text, r.lang, r.source) for r in table(spark, SF, "documents").where("length(text) > 300 and lang = 'en'").orderBy("doc_id").limit(40).collect()]
    long = real[0][1] * 300
    odd = [(None, real[1][1], "en", None), (9001, None, "en", "s"), (9002, "", None, "s"), (9003, "123 !!", "en", "s"), (9004, long, "en", "s"), (9005, long, None, "t")]
    rows = [(*r, None, "k", 1, "x") for r in [*real, *odd, real[2], real[2]]]
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    kept = []
    for name, stage in P.STAGES:
        kept.append(written(stage(spark, kept[-1] if kept else docs, SF), name))
        if stage is not P.encode:
            assert kept[-1].columns == docs.columns
            assert kept[-1].where("near_key <> 'k' or copy <> 1 or lang_score <> 'x'").isEmpty()
    language, toxic, near, mixed, ids = kept
    ids_of = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    assert not {9001, 9002, 9003} & set(ids_of(language)) and {9004, 9005} <= set(ids_of(language)) and ids_of(language)[real[2][0]] == 3
    copies = (real[0][0], 9004, 9005)  # the long texts repeat the first one, so they hold the same n-grams
    assert sum(ids_of(near)[i] for i in copies) == (1 if any(ids_of(toxic)[i] for i in copies) else 0) and ids_of(near)[real[2][0]] <= 1 and max(ids_of(near).values()) == 1
    assert ids.count() == mixed.count()
    for stage in (f for _, f in P.STAGES):
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0
