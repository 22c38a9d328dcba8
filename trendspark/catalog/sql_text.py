"""SQL (DuckDB) spellings of the text builders in ``trendspark.functions.text``."""

from __future__ import annotations

from trendspark import schema as S
from trendspark.functions.text import DIGIT, NOT_WORD_OR_SPACE, WORD, WORD_RUN, WS, WS_RUN, portable, year_pattern


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def t(x: str) -> str:
    return f"coalesce({x}, '')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({t(x)}, {q(WS_RUN)}), lambda w: w <> '')"


def clean(x: str) -> str:
    inner = f"regexp_replace(lower({t(x)}), {q(NOT_WORD_OR_SPACE)}, ' ', 'g')"
    return f"trim(regexp_replace({inner}, {q(WS_RUN)}, ' ', 'g'))"


def char_count(x: str) -> str:
    return f"CAST(length({t(x)}) AS INTEGER)"


def word_count(x: str) -> str:
    return f"CAST(len({words(x)}) AS INTEGER)"


def substring_count(x: str, needle: str) -> str:
    return f"CAST((length({t(x)}) - length(replace({t(x)}, {q(needle)}, ''))) / {len(needle)} AS INTEGER)"


def phrase_hits(cleaned: str, phrases) -> str:
    return "(" + " + ".join(f"CASE WHEN instr({cleaned}, {q(p)}) > 0 THEN 1 ELSE 0 END" for p in phrases) + ")"


def word_hits(cleaned: str, vocab) -> str:
    toks = f"string_split({cleaned}, ' ')"
    return "(" + " + ".join(f"CAST(list_contains({toks}, {q(w)}) AS INTEGER)"
                            for w in dict.fromkeys(vocab)) + ")"


def has_literal(x: str, s: str) -> str:
    return f"CASE WHEN instr({t(x)}, {q(s)}) > 0 THEN 1 ELSE 0 END"


def has_pattern(x: str, pattern: str, ignore_case: bool = False) -> str:
    p = ("(?i)" if ignore_case else "") + pattern
    return f"CASE WHEN regexp_matches({t(x)}, {q(p)}) THEN 1 ELSE 0 END"


def caps_words(x: str) -> str:
    return (f"list_filter({words(x)}, lambda w: upper(w) = w AND lower(w) <> w AND length(w) > 1)")


def caps_count(x: str) -> str:
    return f"CAST(len({caps_words(x)}) AS INTEGER)"


def caps_percentage(x: str) -> str:
    return (f"CASE WHEN {word_count(x)} = 0 THEN 0.0 "
            f"ELSE CAST({caps_count(x)} AS DOUBLE) * 100 / {word_count(x)} END")


def caps_count_regex(x: str) -> str:
    return (f"CAST(len(list_filter(regexp_extract_all({t(x)}, {q(WORD_RUN)}), "
            f"lambda w: regexp_full_match(w, '[A-Z]{{2,}}'))) AS INTEGER)")


def bracket_count(x: str) -> str:
    return f"CAST(length({t(x)}) - length(regexp_replace({t(x)}, '[(\\[{{]', '', 'g')) AS INTEGER)"


def diversity(cleaned: str) -> str:
    toks = f"list_filter(string_split({cleaned}, ' '), lambda w: w <> '')"
    return (f"CASE WHEN len({toks}) = 0 THEN 0.0 "
            f"ELSE CAST(len(list_distinct({toks})) AS DOUBLE) / len({toks}) END")


def title_features(x: str = "title") -> list[str]:
    c = clean(x)
    return [
        f"{char_count(x)} AS title_char_count",
        f"{word_count(x)} AS title_word_count",
        f"{phrase_hits(c, S.CLICKBAIT_PHRASES)} AS clickbait_score",
        f"{word_hits(c, S.POSITIVE_WORDS)} AS title_positive_words",
        f"{word_hits(c, S.NEGATIVE_WORDS)} AS title_negative_words",
        f"{has_literal(x, '?')} AS title_has_question",
        f"{has_literal(x, '!')} AS title_has_exclamation",
        f"{has_pattern(x, DIGIT)} AS title_has_number",
        f"{caps_count(x)} AS title_caps_count",
        f"{caps_percentage(x)} AS title_caps_percentage",
        f"{bracket_count(x)} AS title_brackets_count",
        f"{has_pattern(x, '[\\[\\](){}]')} AS title_has_brackets",
        f"{has_pattern(x, f'[^{WORD}{WS}?!.,]')} AS title_has_special",
        f"{diversity(c)} AS title_word_diversity",
        f"{has_pattern(x, '[\\x{10000}-\\x{10FFFF}]')} AS title_has_emoji",
    ]


def pattern_flags(x: str = "title") -> list[str]:
    return [
        f"{has_pattern(x, portable(S.PATTERN_PART_NUMBER), True)} AS title_has_part_number",
        f"{has_pattern(x, year_pattern())} AS title_has_year",
        f"{has_pattern(x, portable(S.PATTERN_TUTORIAL), True)} AS title_has_tutorial",
        f"{has_pattern(x, portable(S.PATTERN_REVIEW), True)} AS title_has_review",
        f"{has_pattern(x, S.PATTERN_REACTION, True)} AS title_has_reaction",
        f"{has_pattern(x, S.PATTERN_CLICKBAIT, True)} AS title_is_clickbait",
    ]


def description_features(x: str = "description") -> list[str]:
    out = [
        f"{char_count(x)} AS desc_char_count",
        f"{word_count(x)} AS desc_word_count",
        f"{substring_count(x, 'http')} AS desc_url_count",
        f"{substring_count(x, '#')} AS desc_hashtag_count",
        f"{substring_count(x, '@')} AS desc_mention_count",
        f"{has_literal(x, 'http')} AS description_has_links",
        f"{has_pattern(x, portable(S.PATTERN_TIMESTAMP))} AS has_timestamps",
        f"{has_pattern(x, S.PATTERN_MUSIC, True)} AS has_music_credits",
        f"{has_pattern(x, S.PATTERN_SPONSOR, True)} AS has_sponsor",
    ]
    for p in S.SOCIAL_PLATFORMS:
        out.append(f"CASE WHEN instr(lower({t(x)}), {q(p)}) > 0 THEN 1 ELSE 0 END AS has_{p}_link")
    return out


def parse_tags(x: str) -> str:
    """F48 in SQL: blank -> []; valid JSON list -> list; else comma split with strip."""
    trim = f"'^[{WS}]+|[{WS}]+$'"
    s = f"regexp_replace(coalesce({x}, ''), {trim}, '', 'g')"
    return (f"CASE WHEN {s} = '' THEN []::VARCHAR[] "
            f"WHEN starts_with({s}, '[') AND ends_with({s}, ']') AND try(CAST(json({s}) AS VARCHAR[])) IS NOT NULL "
            f"THEN try(CAST(json({s}) AS VARCHAR[])) "
            f"ELSE list_transform(string_split({s}, ','), lambda x: regexp_replace(x, {trim}, '', 'g')) END")
