"""License scan: ordered signature rules over normalised words.

A text that holds none of the anchors is done once its words are counted. For the others the
words get two blanks between them, the rules whose keyword occurs are run, and
each match becomes a detection: an interval of words, a label, a priority and a confidence.
A detection falls if another one of the same or a higher priority contains its interval (of two
equal intervals the higher priority stays, then the earlier rule). Detections are sorted by
begin and falling end, so the largest end before each one, by priority, decides this. A text with n
detections takes n log n steps.

All of it happens within the row, as built-in expressions: no shuffle, no join, no Python. A
hot source, repeated ids or many copies make no difference.

Results: null text counts as empty (no words, no labels, score 0); texts are scanned whole; each
input row gives one row; a null id stays null; empty tables give an empty table; extra columns
are not read. Labels of the base phrases always stay, also where a longer detection contains
them. The score is the largest confidence of a detection that stays, else 0.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.llm.license_rules import ANCHORS, BASE, LicenseRule, rules

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BEGIN, END = "\x01", "\x02"  # no word holds them
DETECTION = "struct<begin:bigint,end:bigint,rule:int,label:string,priority:int,confidence:double,base:boolean>"


def over_words(pattern: str) -> str:
    """The pattern for text where each word has a blank of its own on both sides."""
    return " (?:" + pattern.replace(" ", "  ") + ") "


def _table(wanted: list[LicenseRule]) -> Column:
    base = [(f" {phrase.split()[0]} ", over_words(phrase), label, 1, 0.6, True) for phrase, label in BASE]
    more = [(f" {r.keyword} ", over_words(r.pattern), r.label, r.priority, r.confidence, False) for r in wanted]
    row = lambda i, r: F.struct(*(F.lit(v).alias(n) for n, v in zip(("keyword", "pattern", "label", "priority", "confidence", "base"), r, strict=True)), F.lit(i).alias("rule"))
    return F.array(*(row(i, r) for i, r in enumerate(base + more)))


def _blanks(part: Column) -> Column:
    return F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))


def _matches(norm: Column, rule: Column) -> Column:
    """Detections of one rule. A mark of its own is put on both sides of each match, and the text cut
    into words and marks: the k-th pair of marks has 2k marks before it, so its words begin that many
    places before it."""
    marked = F.regexp_replace(norm, F.concat(F.lit("("), rule["pattern"], F.lit(")")), F.lit(f" {BEGIN}$1{END} "))

    def spans(text):
        places = lambda parts, mark: F.filter(F.transform(parts, lambda w, i: F.when(w == mark, i)), lambda i: i.isNotNull())
        ends = lambda parts: F.transform(F.array(places(parts, END)), lambda e: F.transform(places(parts, BEGIN), lambda at, k: F.struct((at - 2 * k).cast("long").alias("begin"), (F.get(e, k) - 2 * k - 1).cast("long").alias("end"))))[0]
        found = F.transform(F.array(F.split(F.trim(text), " +")), ends)[0]
        return F.when(text != norm, found).otherwise(F.array().cast("array<struct<begin:bigint,end:bigint>>"))

    named = lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["confidence"].alias("confidence"), rule["base"].alias("base"))
    return F.transform(F.transform(F.array(marked), spans)[0], named)


def _largest_before(values: Column) -> Column:
    """For each place the largest of the values up to it: in round k each takes in the one 2**k places
    before it, so n values take n log n steps and no array grows."""
    wider = lambda a, k: F.transform(a, lambda x, i: F.greatest(x, F.get(a, i - F.pow(F.lit(2), k).cast("int"))))
    rounds = lambda a: F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(a), F.lit(2)))).cast("int"))
    return F.transform(F.array(values), lambda a: F.aggregate(rounds(a), a, wider))[0]


def _standing(found: Column) -> Column:
    """The detections that no other of the same or a higher priority contains."""
    order = F.sort_array(F.transform(found, lambda d: F.struct(d["begin"].alias("begin"), (-d["end"]).alias("minus_end"), (-d["priority"]).alias("minus_priority"), d["rule"].alias("rule"), d.alias("d"))))

    def keep(sorted_):
        ends_from = lambda t: _largest_before(F.transform(sorted_, lambda x: F.when(x["d"]["priority"] >= t, x["d"]["end"]).otherwise(F.lit(-1).cast("long"))))
        by_priority = F.array(*(ends_from(t) for t in (1, 2, 3)))
        inside = lambda e, x, i: (i > 0) & (F.get(F.get(e, x["d"]["priority"] - 1), i - 1) >= x["d"]["end"])
        return F.transform(F.array(by_priority), lambda e: F.filter(sorted_, lambda x, i: ~inside(e, x, i)))[0]

    return F.transform(F.transform(F.array(order), keep)[0], lambda x: x["d"])


def detections(docs: DataFrame, wanted: list[LicenseRule] | None = None) -> DataFrame:
    """(doc_id, n_words, found, standing) for every row: all detections, and those that stay."""
    wanted = rules() if wanted is None else wanted
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast(f"array<{DETECTION}>")
    plain = rows.select("doc_id", F.trim(F.regexp_replace("text", BETWEEN, " ")).alias("plain"))
    lowered = plain.select("*", F.lower("plain").alias("lowered"))  # may lower more than A-Z: only a prefilter
    anchored = reduce(or_, (F.contains(F.col("lowered"), F.lit(a)) for a in ANCHORS))
    norm = F.when(anchored, F.concat(F.lit(" "), F.replace(F.translate("plain", UPPER, LOWER), F.lit(" "), F.lit("  ")), F.lit(" ")))
    n_words = F.when(F.length("plain") == 0, 0).otherwise(_blanks(F.col("plain")) + 1)
    with_norm = lowered.select("doc_id", n_words.cast("long").alias("n_words"), norm.alias("norm"))
    run = F.filter(_table(wanted), lambda r: F.contains(F.col("norm"), r["keyword"]))
    found = F.flatten(F.transform(run, lambda r: _matches(F.col("norm"), r)))
    with_found = with_norm.select("doc_id", "n_words", F.when(F.col("norm").isNotNull(), found).otherwise(none).cast(f"array<{DETECTION}>").alias("found"))
    return with_found.select("*", F.when(F.size("found") > 0, _standing(F.col("found"))).otherwise(none).alias("standing"))


def scanned(docs: DataFrame, wanted: list[LicenseRule] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections)."""
    base = F.filter("found", lambda d: d["base"])
    begins = F.transform(base, lambda d: d["begin"])
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return detections(docs, wanted).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(begins).alias("first_word"),
        F.array_max(begins).alias("last_word"),
        listed(F.transform(base, lambda d: d["label"])).alias("base_labels"),
        listed(F.transform(F.concat(base, F.col("standing")), lambda d: d["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform("standing", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        F.transform("standing", lambda d: F.struct(d["begin"].alias("begin"), d["end"].alias("end"), d["label"].alias("label"))).alias("detections"),
    )
