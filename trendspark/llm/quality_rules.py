"""Quality rules: a decision list learned by sequential covering, as Spark expressions.

Statistics of whole texts are built-in expressions. A rule is a conjunction of thresholds on
them. Rules are learned one after the other: *grow* adds the threshold with the largest FOIL
gain until no clean row of the growing part is covered, *prune* takes off the last conditions
as long as the held part scores no worse, and a rule stands if it is precise enough on both
parts; the rows it covers leave the table. The list is an ordered CASE expression: the first
rule that holds rejects a text, a text that no rule holds for is kept.

Everything runs as DataFrame operations without Python on the executors: counts of rows for each
(statistic, threshold) are one grouped aggregation for each condition, of which the driver sees
statistics x thresholds rows. The list is learned from at most ``SAMPLE_ROWS`` labelled rows
(documented bound; chosen by a hash of the id); it is applied to all rows in the scan, without
a shuffle.

Results: null text counts as empty; texts are taken whole; each input row gives one row, repeated
ids and null ids included. Ids with several different labels, or none, teach nothing. Without
labels (or without one of the two classes) there are no rules, and only the fixed base decides.
Statistics of a text without words are 0. Empty tables give an empty table. Extra columns are
not read. Repeated windows are told apart by their words, not by a hash. A list has at most
``MOST_RULES`` rules of at most ``MOST_CONDITIONS`` thresholds each.

Words and counts are bound once a row (``common.bound``), so a filter on the result, such as
``where("kept")``, costs no second reading of the text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import bound, labelled_sample, written

SAMPLE_ROWS = 10_000
THRESHOLDS, MOST_RULES, MOST_CONDITIONS = 24, 12, 4
LEAST_PRECISION, LEAST_ROWS = 0.95, 8

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]+"
FEATURES = ("symbols_a_word", "dup_line_share", "repeat_share", "letters_a_word", "capital_share", "shouts_a_word", "words")


def _count(c: Column, pattern: str) -> Column:
    """Characters of ``c`` that runs of the pattern cover."""
    return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))).cast("long")


def repeated_words(windows: Column) -> Column:
    """Words that lie in a window which stands twice or more; ``windows``: one for each word but
    the last four (a text of fewer than five words has none). The windows are sorted with their places, neighbours compared, and the union
    of the intervals of the repeated ones measured."""
    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    starts = F.transform(
        F.array(placed),  # binds the sorted array once
        lambda s: F.sort_array(
            F.filter(
                F.transform(
                    s,
                    lambda x, j: F.when(
                        F.coalesce((j > 0) & (F.get(s, j - 1)["w"] == x["w"]), F.lit(False)) | F.coalesce(F.get(s, j + 1)["w"] == x["w"], F.lit(False)), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
        ),
    )[0]
    state = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(starts, state, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(5), i - s["last"])).alias("n")))["n"]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the counts of the base, and the columns of ``FEATURES``) for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    plain = bound(rows, norm=F.trim(F.regexp_replace("text", BLANK + "+", " ")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.ltrim(x, F.lit(" \t\x0b\f\r")) != "")
    words = F.when(F.col("norm") == "", F.array().cast("array<string>")).otherwise(F.split("norm", " "))
    cut = bound(plain, lines=lines, words_=words)
    word = lambda i: F.get("words_", i)
    each = F.slice("words_", F.lit(1), F.greatest(F.size("words_") - 4, F.lit(0)))  # the first word of each window
    hashed = bound(cut, hashes=F.transform(each, lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2), word(i + 3), word(i + 4))))
    # equal windows have equal hashes: only where two hashes agree are the windows compared themselves
    exact = F.transform(each, lambda w, i: F.concat_ws(" ", w, word(i + 1), word(i + 2), word(i + 3), word(i + 4)))
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    counted = bound(
        hashed,
        n_words=F.size("words_").cast("long"),
        word_chars=F.length(F.replace("norm", F.lit(" "), F.lit(""))).cast("long"),
        n_symbols=_count(F.col("text"), SYMBOLS),
        n_capitals=_count(F.col("norm"), "[A-Z]+"),
        n_shouts=_count(F.col("norm"), "!+"),
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_repeat_words=F.when(repeated, repeated_words(exact)).otherwise(F.lit(0).cast("long")),
    ).select("doc_id", "n_words", "word_chars", "n_symbols", "n_capitals", "n_shouts", "n_lines", "n_dup_lines", "n_repeat_words")
    a = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(F.lit(0.0))
    return counted.select(
        "*",
        a("n_symbols", "n_words").alias("symbols_a_word"), a("n_dup_lines", "n_lines").alias("dup_line_share"),
        a("n_repeat_words", "n_words").alias("repeat_share"), a("word_chars", "n_words").alias("letters_a_word"),
        a("n_capitals", "word_chars").alias("capital_share"), a("n_shouts", "n_words").alias("shouts_a_word"),
        F.col("n_words").cast("double").alias("words"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature >= limit, else feature < limit
    limit: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.limit if self.above else F.col(self.feature) < self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.limit:g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects the row: one ordered CASE."""
    if not rules:
        return F.lit(True)
    out = F.when(holds(rules[0]), F.lit(False))
    for r in rules[1:]:
        out = out.when(holds(r), F.lit(False))
    return out.otherwise(F.lit(True))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def learn(statistics: DataFrame, thresholds: int = THRESHOLDS, most_rules: int = MOST_RULES) -> list[Rule]:
    """``statistics``: FEATURES, label (1: clean), held (row only for pruning). Rules for label 0."""
    limits = statistics.agg(*(F.percentile_approx(F.when(F.col("label") == 0, F.col(f)), [(i + 0.5) / thresholds for i in range(thresholds)]).alias(f) for f in FEATURES)).first()
    best = statistics.agg(*(F.percentile_approx(F.when(F.col("label") == 1, F.col(f)), [0.0, 0.25, 0.5, 0.75, 0.99, 0.999, 1.0]).alias(f) for f in FEATURES)).first()
    # limits lie between what is seen: halfway from each value to the next larger one
    cuts: dict[str, list[float]] = {}
    for f in FEATURES:
        seen = sorted({*(limits[f] or []), *(best[f] or [])})
        cuts[f] = [(a + b) / 2 for a, b in zip(seen, seen[1:], strict=False)]
    bins = F.array(*(F.struct(F.lit(f).alias("f"), sum((F.when(F.col(f) >= c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias("bin")) for f in FEATURES))
    rules: list[Rule] = []
    left = statistics
    while len(rules) < most_rules:
        rule: Rule = ()
        while len(rule) < MOST_CONDITIONS:
            counts = left.where(~F.col("held") & holds(rule)).select("label", F.explode(bins).alias("x")).groupBy("x.f", "x.bin").agg(F.sum(1 - F.col("label")).alias("p"), F.sum("label").alias("n")).collect()
            of = {f: {r["bin"]: (r["p"], r["n"]) for r in counts if r["f"] == f} for f in FEATURES}
            p0, n0 = (sum(v[i] for v in of[FEATURES[0]].values()) for i in (0, 1))
            if p0 < LEAST_ROWS or not n0:
                break
            choices = []
            for f in FEATURES:
                for k, limit in enumerate(cuts[f]):
                    up = [sum(v[i] for b, v in of[f].items() if b > k) for i in (0, 1)]
                    for above, (p, n) in ((True, up), (False, (p0 - up[0], n0 - up[1]))):
                        if p >= LEAST_ROWS:
                            choices.append((_gain(p, n, p0, n0), f, above, limit))
            top = max(choices, default=(0.0,))
            if top[0] <= 1e-9:
                break
            rule += (Condition(*top[1:]),)
        if not rule:
            break
        forms = [rule[: i + 1] for i in range(len(rule))]
        sums = [F.sum(F.when(holds(x) & (F.col("held") == h) & (F.col("label") == y), 1).otherwise(0)) for x in forms for h in (True, False) for y in (0, 1)]
        got = [v or 0 for v in left.agg(*(s.alias(f"c{i}") for i, s in enumerate(sums))).first()]
        scored = []
        for i, x in enumerate(forms):
            hp, hn, gp, gn = got[4 * i : 4 * i + 4]
            if gp >= LEAST_ROWS and gp >= LEAST_PRECISION * (gp + gn) and hp >= LEAST_PRECISION * (hp + hn):
                scored.append(((hp - hn) / (hp + hn) if hp + hn else 0.0, -i, x))
        if not scored:
            break
        rule = max(scored)[2]
        rules.append(rule)
        left = left.where(~holds(rule))
    return rules


def rules_from(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules learned from at most ``sample_rows`` labelled rows of ``docs``."""
    taught = labelled_sample(labels, "quality", sample_rows)
    known = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id")
    stats = with_statistics(known).join(F.broadcast(taught), "doc_id")
    table = written(stats.select(*FEATURES, "label", (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(3)) == 0).alias("held")), "quality-statistics")
    return learn(table)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = with_statistics(docs).withColumn("base_failed", base_failed)
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(*counts, (~F.col("base_failed") & verdict(rules)).alias("kept"))
