"""From raw documents to token ids, in five stages, each written as Parquet and read again.

Each stage works on all rows that the one before it kept and returns the columns of documents;
the last returns token ids. Further columns of the input stay as they are in the first four stages, also
where their names are those of the stages' own columns. An empty table goes through as an empty table.
Texts are read whole, of any length. A row without an id is a document like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm import bpe_codec, language_id, mixing, ngram_join, toxicity
from trendspark.llm.common import table, written


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that the model knows, which is learned from the rows' own lang. Null and empty
    texts and those without a letter go; a null lang teaches nothing and its row is judged like any other;
    repeated rows are judged alike and teach once. If no row has a lang, no row stays."""
    return language_id.accepted(docs, language_id.learn(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is below the threshold; learned from the labelled documents (all documents of the
    folder, not only those that came this far). Null and empty texts stay; equal texts get equal scores, and a
    score at the threshold goes; without labels a few fixed words decide."""
    return toxicity.accepted(docs, toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, null ids last, then by a hash of its
    text; a row that repeats another's id and text goes. Null and wordless texts are copies of nothing and all stay."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources at equal shares, by repeated and left out documents, in a global random order. Rows without a
    source are a source of their own; repeated rows of one id are drawn alike."""
    return mixing.mixed(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the hash of the text that they decode to. A null or empty text has no ids."""
    found = bpe_codec.encoded(docs, texts_too=True)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_languages),
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("source_mixing", mix_sources),
    ("bpe_codec", encode),
]

#: No SQL: the first two stages apply learned models, the last a tokenizer. tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
