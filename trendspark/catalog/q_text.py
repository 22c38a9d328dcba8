"""Text-feature queries over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendspark import schema as S
from trendspark.catalog import sql_text as Q
from trendspark.catalog.registry import query, rounded
from trendspark.catalog.views_sql import with_views
from trendspark.functions import arrays as AR
from trendspark.functions import text as TX
from trendspark.operators import aggregates as AG
from trendspark.sources.adapters import texts


def _cols(sql_list):
    return ",\n       ".join(sql_list)


SQL_TITLE_TEXT = with_views("texts") + f"""
SELECT doc_id, {_cols(Q.title_features('title'))}
FROM texts
"""


@query("title_text_features", SQL_TITLE_TEXT)
def title_text_features(spark, sf):
    """F32-F42 on titles: counts, clickbait and lexicon hits, flags, caps, brackets, diversity."""
    return texts(spark, sf).select("doc_id", *[c.alias(n) for n, c in TX.title_features("title").items()])


SQL_CLEAN_TEXT = with_views("texts") + f"""
SELECT doc_id, {Q.clean('title')} AS clean_title, {Q.clean('description')} AS clean_description FROM texts
"""


@query("clean_text", SQL_CLEAN_TEXT)
def clean_text(spark, sf):
    """F32 on whole titles and whole descriptions."""
    return texts(spark, sf).select("doc_id", TX.clean_text("title").alias("clean_title"),
                                   TX.clean_text("description").alias("clean_description"))


SQL_CAPS = with_views("texts") + f"""
SELECT doc_id, {Q.caps_count('description')} AS caps_count,
       {Q.caps_percentage('description')} AS caps_percentage,
       {Q.caps_count_regex('description')} AS caps_count_regex
FROM texts
"""


@query("caps_features", SQL_CAPS)
def caps_features(spark, sf):
    """both all-caps definitions on whole descriptions."""
    return texts(spark, sf).select(
        "doc_id", TX.caps_count("description").alias("caps_count"),
        TX.caps_percentage("description").alias("caps_percentage"),
        TX.caps_count_regex("description").alias("caps_count_regex"))


SQL_DIVERSITY = with_views("texts") + f"""
SELECT doc_id, {Q.diversity(Q.clean('description'))} AS word_diversity,
       {Q.word_count('description')} AS word_count, {Q.char_count('description')} AS char_count
FROM texts
"""


@query("diversity", SQL_DIVERSITY)
def diversity(spark, sf):
    """F33 + F40 on whole descriptions."""
    return texts(spark, sf).select(
        "doc_id", TX.word_diversity(TX.clean_text("description")).alias("word_diversity"),
        TX.word_count("description").alias("word_count"), TX.char_count("description").alias("char_count"))


_CD = Q.clean("description")
SQL_LEXICON = with_views("texts") + f"""
SELECT doc_id, clickbait_score, positive_words, negative_words, positive_words - negative_words AS emotion_balance
FROM (SELECT doc_id, {Q.phrase_hits(_CD, S.CLICKBAIT_PHRASES)} AS clickbait_score,
             {Q.word_hits(_CD, S.POSITIVE_WORDS)} AS positive_words,
             {Q.word_hits(_CD, S.NEGATIVE_WORDS)} AS negative_words FROM texts)
"""


@query("lexicon_hits", SQL_LEXICON)
def lexicon_hits(spark, sf):
    """F34-F36 on whole descriptions (list words are fixed parameters)."""
    t = texts(spark, sf).select("doc_id", TX.clean_text("description").alias("c"))
    return t.select(
        "doc_id",
        TX.phrase_hits("c", S.CLICKBAIT_PHRASES).alias("clickbait_score"),
        TX.word_hits("c", S.POSITIVE_WORDS).alias("positive_words"),
        TX.word_hits("c", S.NEGATIVE_WORDS).alias("negative_words"),
    ).withColumn("emotion_balance", F.col("positive_words") - F.col("negative_words"))


SQL_PATTERN_FLAGS = with_views("texts") + f"""
SELECT doc_id, {_cols(Q.pattern_flags('description'))} FROM texts
"""


@query("pattern_flags", SQL_PATTERN_FLAGS)
def pattern_flags(spark, sf):
    """F43 patterns over whole descriptions."""
    flags = TX.pattern_flags("description")
    return texts(spark, sf).select("doc_id", *[c.alias(n) for n, c in flags.items()])


SQL_DESCRIPTION_FLAGS = with_views("texts") + f"""
SELECT doc_id, {_cols(Q.description_features('description'))} FROM texts
"""


@query("description_flags", SQL_DESCRIPTION_FLAGS)
def description_flags(spark, sf):
    """F33/F41/F44/F45 over whole descriptions."""
    feats = TX.description_features("description")
    return texts(spark, sf).select("doc_id", *[c.alias(n) for n, c in feats.items()])


SQL_WORD_FREQ = with_views("texts") + f"""
SELECT word, count(*) AS frequency
FROM (SELECT unnest(list_filter(regexp_extract_all(lower(title), {Q.q(TX.WORD_RUN)}),
                                lambda w: regexp_full_match(w, '[a-z]{{3,}}'))) AS word FROM texts)
GROUP BY word ORDER BY frequency DESC, word LIMIT 30
"""


@query("word_frequency_topk", SQL_WORD_FREQ)
def word_frequency_topk(spark, sf):
    """Top 30 title words (whole words of >= 3 ASCII letters), all languages."""
    return AG.word_frequency(texts(spark, sf), "title", 30)


SQL_DESC_WORD_FREQ = with_views("texts") + f"""
SELECT word, count(*) AS frequency
FROM (SELECT unnest(list_filter(regexp_extract_all(lower(description), {Q.q(TX.WORD_RUN)}),
                                lambda w: regexp_full_match(w, '[a-z]{{3,}}'))) AS word FROM texts)
GROUP BY word ORDER BY frequency DESC, word LIMIT 100
"""


@query("word_frequency_descriptions", SQL_DESC_WORD_FREQ)
def word_frequency_descriptions(spark, sf):
    """A24 over whole description texts (top 100)."""
    return AG.word_frequency(texts(spark, sf), "description", 100)


SQL_TAGS = with_views("texts") + f"""
SELECT doc_id, CAST(len(tags_list) AS INTEGER) AS tag_count,
       CASE WHEN len(tags_list) = 0 THEN 0.0
            ELSE list_avg(list_transform(tags_list, lambda x: length(x))) END AS tag_avg_length
FROM (SELECT doc_id, {Q.parse_tags('tags')} AS tags_list FROM texts)
"""


@query("tags_parse", SQL_TAGS)
def tags_parse(spark, sf):
    """F48 + F50: tag text (JSON list or comma list) -> list, count, mean length."""
    t = texts(spark, sf).select("doc_id", AR.parse_tags("tags").alias("tags_list"))
    return t.select("doc_id", F.size("tags_list").alias("tag_count"),
                    AR.mean_length("tags_list").alias("tag_avg_length"))


SQL_TAG_STATS = with_views("texts") + f"""
SELECT region, count(*) AS doc_count, CAST(sum(tag_count) AS BIGINT) AS total_tags,
       round(avg(tag_count), 6) AS avg_tag_count
FROM (SELECT region, len(list_filter(string_split(s, '|'), lambda x: x <> '')) AS tag_count
      FROM (SELECT region, coalesce(tags, '') AS s FROM texts))
GROUP BY region
"""


@query("tag_stats", SQL_TAG_STATS)
def tag_stats(spark, sf):
    """F49 + F50: '|'-separated tags per document, aggregated by region."""
    t = texts(spark, sf).select("region", F.size(AR.split_pipe("tags")).alias("tag_count"))
    out = t.groupBy("region").agg(F.count(F.lit(1)).alias("doc_count"),
                                  F.sum("tag_count").cast("bigint").alias("total_tags"),
                                  F.avg("tag_count").alias("avg_tag_count"))
    return rounded(out, 6)


# --- A14 / A15 / A22 over text flags -------------------------------------------------------
_FLAGS = ["title_has_question", "title_has_exclamation", "title_has_number", "title_has_special",
          "title_has_brackets"]
_FLAG_SQL = [s for s in Q.title_features("title") if any(s.endswith(f"AS {f}") for f in _FLAGS)]

SQL_FLAG_SHARE = with_views("texts") + f"""
SELECT flag, round(pct, 6) AS pct FROM (
  SELECT {", ".join(f"avg({f}) * 100 AS {f}" for f in _FLAGS)}
  FROM (SELECT {_cols(_FLAG_SQL)} FROM texts))
UNPIVOT (pct FOR flag IN ({", ".join(_FLAGS)}))
"""


@query("flag_share", SQL_FLAG_SHARE)
def flag_share(spark, sf):
    """Share of titles with each flag, ranked."""
    feats = TX.title_features("title")
    t = texts(spark, sf).select(*[feats[f].alias(f) for f in _FLAGS])
    return rounded(AG.flag_share(t, _FLAGS), 6)


SQL_FLAG_IMPACT = with_views("texts") + f"""
SELECT flag, round(impact, 6) AS impact FROM (
  SELECT {", ".join(f"avg(CASE WHEN {f} = 1 THEN quality END) - avg(quality) AS {f}" for f in _FLAGS)}
  FROM (SELECT l.quality, {_cols(_FLAG_SQL)} FROM texts LEFT JOIN labels l USING (doc_id)))
UNPIVOT INCLUDE NULLS (impact FOR flag IN ({", ".join(_FLAGS)}))
"""


@query("flag_impact", SQL_FLAG_IMPACT)
def flag_impact(spark, sf):
    """Labelled quality given a title flag minus overall mean."""
    feats = TX.title_features("title")
    t = texts(spark, sf, with_labels=True).select("quality", *[feats[f].alias(f) for f in _FLAGS])
    return rounded(AG.flag_impact(t, _FLAGS, "quality"), 6)


SQL_TITLE_BUCKETS = with_views("texts") + """
SELECT title_length_group, count(*) AS video_count, round(avg(quality), 6) AS avg_engagement
FROM (SELECT l.quality, CASE """ + " ".join(
    f"WHEN length(title) > {lo} AND length(title) <= {hi} THEN '{lab}'"
    for lo, hi, lab in zip(S.TITLE_LENGTH_EDGES[:-1], S.TITLE_LENGTH_EDGES[1:], S.TITLE_LENGTH_LABELS)
) + """ END AS title_length_group FROM texts LEFT JOIN labels l USING (doc_id))
WHERE title_length_group IS NOT NULL GROUP BY title_length_group
"""


@query("title_length_buckets", SQL_TITLE_BUCKETS)
def title_length_buckets(spark, sf):
    """A22 (+F13): labelled quality by right-closed title-length bucket."""
    t = texts(spark, sf, with_labels=True).select("quality", F.length("title").alias("title_length"))
    return rounded(AG.title_length_buckets(t, "title_length", "quality"), 6)


SQL_HIST_CLICKBAIT = with_views("texts") + f"""
SELECT bin, count(*) AS count, round(lo + w * bin / 10, 9) AS bin_lo, round(lo + w * (bin + 1) / 10, 9) AS bin_hi
FROM (SELECT CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((x - lo) / w * 10), 9) END AS INTEGER) AS bin, lo, w
      FROM (SELECT {Q.phrase_hits(Q.clean('description'), S.CLICKBAIT_PHRASES)} AS x FROM texts),
           (SELECT min(x) AS lo, max(x) - min(x) AS w
            FROM (SELECT {Q.phrase_hits(Q.clean('description'), S.CLICKBAIT_PHRASES)} AS x FROM texts)))
GROUP BY bin, lo, w
"""


@query("hist_clickbait", SQL_HIST_CLICKBAIT)
def hist_clickbait(spark, sf):
    """10 bins of the clickbait score of whole descriptions."""
    from trendspark.operators import stats as ST
    t = texts(spark, sf).select(TX.phrase_hits(TX.clean_text("description"), S.CLICKBAIT_PHRASES).alias("x"))
    return rounded(ST.histogram(t, "x", 10), 9, only=["bin_lo", "bin_hi"])
