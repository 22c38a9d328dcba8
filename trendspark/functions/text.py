"""Text column expressions.

Regex portability: Java (Spark) and RE2 (the SQL oracle) disagree with each
other and with Python on ``\\w``, ``\\s``, ``\\d`` and ``\\b`` outside ASCII. The
builders therefore spell character classes out:

* word character = ``[\\p{L}\\p{N}_]`` (Python's Unicode ``\\w``: letters, numbers, ``_``)
* whitespace     = ``WS`` below (Python's ``str.split()`` separators)
* digit          = ``\\p{Nd}`` (Python's Unicode ``\\d``)
* ``\\b``          = look-around-free: a run of word characters is matched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark import schema as S

WS = (r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
WS_RUN = f"[{WS}]+"
WORD_RUN = f"[{WORD}]+"
NOT_WORD_OR_SPACE = f"[^{WORD}{WS}]"
NOT_WORD_RUN = f"[^{WORD}]+"


def portable(pattern: str) -> str:
    """Rewrite ``\\s`` and ``\\d`` (outside classes) to the explicit classes above."""
    return pattern.replace(r"\s", f"[{WS}]").replace(r"\d", DIGIT)


def year_pattern() -> str:
    """``\\b20\\d{2}\\b|\\b19\\d{2}\\b`` with the word boundary spelled out."""
    return f"(^|[^{WORD}])(19|20){DIGIT}{{2}}($|[^{WORD}])"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_or_empty(x) -> Column:
    """Null -> '' (the original fills missing text with '')."""
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def words(x) -> Column:
    """Python ``str.split()``: whitespace-separated tokens, no empty tokens."""
    return F.filter(F.split(text_or_empty(x), WS_RUN), lambda w: w != "")


def clean_text(x) -> Column:
    """F32: lower, every char that is neither word nor space -> ' ', squeeze, trim (no space is a word
    character, so a run of both kinds becomes one space at once)."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(x)), NOT_WORD_RUN, " "))


def char_count(x) -> Column:
    """characters (code points)."""
    return F.length(text_or_empty(x))


def word_count(x) -> Column:
    """whitespace-separated words."""
    return F.size(words(x))


def substring_count(x, needle: str) -> Column:
    """non-overlapping occurrences of a literal (needle must not overlap itself)."""
    t = text_or_empty(x)
    return ((F.length(t) - F.length(F.replace(t, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def phrase_hits(cleaned, phrases: list[str]) -> Column:
    """number of listed phrases found as substrings (duplicates in the list count twice)."""
    return sum((F.when(F.instr(_c(cleaned), p) > 0, 1).otherwise(0) for p in phrases), F.lit(0))


def word_hits(cleaned, vocab: list[str]) -> Column:
    """number of distinct listed words that occur as whole tokens (one hash intersection
    of the token array with the word list, instead of one linear scan per listed word)."""
    return token_hits(F.split(_c(cleaned), " "), vocab)


def token_hits(tokens, vocab: list[str]) -> Column:
    return F.size(F.array_intersect(F.array(*[F.lit(w) for w in dict.fromkeys(vocab)]), _c(tokens)))


def has_literal(x, s: str) -> Column:
    """1 if the literal occurs."""
    return F.when(F.instr(text_or_empty(x), s) > 0, 1).otherwise(0)


def has_pattern(x, pattern: str, ignore_case: bool = False) -> Column:
    """1 if the (portable) regex is found."""
    p = ("(?i)" if ignore_case else "") + pattern
    return F.when(text_or_empty(x).rlike(p), 1).otherwise(0)


def caps_words(x) -> Column:
    """words with str.isupper() semantics and length > 1."""
    return upper_words(words(x))


def upper_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1))


def caps_count(x) -> Column:
    return F.size(caps_words(x))


def caps_percentage(x) -> Column:
    """caps words / words * 100; 0 for no words."""
    n = word_count(x)
    return F.when(n == 0, F.lit(0.0)).otherwise(caps_count(x) * 100.0 / n)


def caps_count_regex(x) -> Column:
    """F38 (serving form): whole words of >= 2 upper-case ASCII letters."""
    runs = F.regexp_extract_all(text_or_empty(x), F.lit(WORD_RUN), 0)
    return F.size(F.filter(runs, lambda w: w.rlike("^[A-Z]{2,}$")))


def bracket_count(x) -> Column:
    """number of '(', '[' and '{'."""
    t = text_or_empty(x)
    return (F.length(t) - F.length(F.regexp_replace(t, r"[(\[{]", ""))).cast("int")


def has_brackets(x) -> Column:
    return has_pattern(x, r"[\[\](){}]")


def has_special(x) -> Column:
    """any char other than word, space, ? ! . ,"""
    return has_pattern(x, f"[^{WORD}{WS}?!.,]")


def word_diversity(cleaned) -> Column:
    """distinct / total words of the cleaned text; 0 when empty.

    Cleaned text is trimmed with single spaces, so its only empty token is the empty text
    itself: a plain split needs no per-element filter."""
    c = _c(cleaned)
    toks = F.split(c, " ")
    return F.when(c == "", F.lit(0.0)).otherwise(F.size(F.array_distinct(toks)) / F.size(toks))


def has_emoji(x) -> Column:
    """any code point outside the basic multilingual plane."""
    return has_pattern(x, r"[\x{10000}-\x{10FFFF}]")


def title_features(title="title") -> dict[str, Column]:
    """F32-F43 for a title column (one projection)."""
    return _title_features(title, clean_text(title), word_count(title), caps_count(title), caps_percentage(title), word_diversity(clean_text(title)))


def _title_features(title, cleaned, n_words: Column, n_caps: Column, caps_share: Column, diversity: Column) -> dict[str, Column]:
    return {
        "title_char_count": char_count(title),
        "title_word_count": n_words,
        "clickbait_score": phrase_hits(cleaned, S.CLICKBAIT_PHRASES),
        "title_positive_words": word_hits(cleaned, S.POSITIVE_WORDS),
        "title_negative_words": word_hits(cleaned, S.NEGATIVE_WORDS),
        "title_has_question": has_literal(title, "?"),
        "title_has_exclamation": has_literal(title, "!"),
        "title_has_number": has_pattern(title, DIGIT),
        "title_caps_count": n_caps,
        "title_caps_percentage": caps_share,
        "title_brackets_count": bracket_count(title),
        "title_has_brackets": has_brackets(title),
        "title_has_special": has_special(title),
        "title_word_diversity": diversity,
        "title_has_emoji": has_emoji(title),
    }


def with_title_features(df: DataFrame, title: str = "title") -> DataFrame:
    """``df`` with the columns of ``title_features``; the words and the cleaned text of a title are made once a
    row and not once for each feature and branch that needs them (half the time)."""
    made = df.withColumns({"_words": words(title), "_cleaned": clean_text(title)})
    made = made.withColumns({"_n_words": F.size("_words"), "_n_caps": F.size(upper_words(F.col("_words"))), "_tokens": F.split("_cleaned", " ")})
    n, caps = F.col("_n_words"), F.col("_n_caps")
    share = F.when(n == 0, F.lit(0.0)).otherwise(caps * 100.0 / n)
    diversity = F.when(F.col("_cleaned") == "", F.lit(0.0)).otherwise(F.size(F.array_distinct("_tokens")) / F.size("_tokens"))
    cols = _title_features(title, "_cleaned", n, caps, share, diversity)
    cols |= {"title_positive_words": token_hits("_tokens", S.POSITIVE_WORDS), "title_negative_words": token_hits("_tokens", S.NEGATIVE_WORDS)}
    return made.withColumns(cols).drop("_words", "_cleaned", "_n_words", "_n_caps", "_tokens")


def pattern_flags(title="title") -> dict[str, Column]:
    """case-insensitive title pattern flags."""
    return {
        "title_has_part_number": has_pattern(title, portable(S.PATTERN_PART_NUMBER), True),
        "title_has_year": has_pattern(title, year_pattern()),
        "title_has_tutorial": has_pattern(title, portable(S.PATTERN_TUTORIAL), True),
        "title_has_review": has_pattern(title, portable(S.PATTERN_REVIEW), True),
        "title_has_reaction": has_pattern(title, S.PATTERN_REACTION, True),
        "title_is_clickbait": has_pattern(title, S.PATTERN_CLICKBAIT, True),
    }


def description_features(desc="description") -> dict[str, Column]:
    """F33/F41/F44/F45 for a description column."""
    low = F.lower(text_or_empty(desc))
    out = {
        "desc_char_count": char_count(desc),
        "desc_word_count": word_count(desc),
        "desc_url_count": substring_count(desc, "http"),
        "desc_hashtag_count": substring_count(desc, "#"),
        "desc_mention_count": substring_count(desc, "@"),
        "description_has_links": has_literal(desc, "http"),
        "has_timestamps": has_pattern(desc, portable(S.PATTERN_TIMESTAMP)),
        "has_music_credits": has_pattern(desc, S.PATTERN_MUSIC, True),
        "has_sponsor": has_pattern(desc, S.PATTERN_SPONSOR, True),
    }
    for p in S.SOCIAL_PLATFORMS:
        out[f"has_{p}_link"] = F.when(F.instr(low, p) > 0, 1).otherwise(0)
    return out


def title_length_advice(length) -> Column:
    """+0.5 for 30..70 chars, -0.5 below 20 or above 100, else 0."""
    n = _c(length)
    return (F.when((n >= 30) & (n <= 70), F.lit(0.5))
            .when((n < 20) | (n > 100), F.lit(-0.5)).otherwise(F.lit(0.0)))
