"""Native scans against plain Python: license phrases and rules, quality statistics and rules."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trendspark.llm import license_rules, license_scan, quality_rules

SF = "/root/testdata/sf0.01"
TEXTS = [
    None, "", "   \n\t", "MIT License", "mit  LICENSE mit license", "Licensed under the Apache License, Version 2.0.", "King mit license",
    "the GNU general public license v3 and, see, the MIT-license. general-public\nlicense", "a " * 3000 + "apache license " * 40, "All rights reserved. CC BY-NC 4.0 licensed under CC BY-NC 4.0",
    "one two three four five one two three four five six", "x\nx\n \nx\n\ny z\ny z", "a b c d", "a b c d e", "a b c d e a b c d e a b", "### $$$ <a> | x", "nbsp word 　 wide",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "mit license", "x"), (None, "Apache license", "x")], "doc_id long, text string, n_words string")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_detections(text):
    """Every rule over the words, and what no other detection of its priority or more contains."""
    words = words_of(text)
    norm = " " + "  ".join(words) + " "
    listed = [(p, l, 1, 0.6, True) for p, l in license_rules.BASE] + [(r.pattern, r.label, r.priority, r.confidence, False) for r in license_rules.rules()]
    found = []
    for k, (pattern, label, priority, confidence, base) in enumerate(listed):
        for m in re.finditer(license_scan.over_words(pattern), norm):
            found.append((norm[: m.start()].count(" ") // 2, norm[: m.end()].count(" ") // 2, k, label, priority, confidence, base))
    stays = [d for d in found if not any(e is not d and e[4] >= d[4] and e[0] <= d[0] and e[1] >= d[1] and ((e[0], -e[1], -e[4], e[2]) < (d[0], -d[1], -d[4], d[2])) for e in found)]
    return words, [d for d in found if d[6]], stays


def test_license_scan_against_plain_python(spark, docs):
    real = spark.read.parquet(f"{SF}/documents.parquet").where("lower(text) like '%licens%' or doc_id < 60").select("doc_id", "text", F.lit("x").alias("n_words"))
    rows = docs.union(real)
    want = Counter()
    for r in rows.collect():
        words, base, stays = plain_detections(r.text)
        begins = [d[0] for d in base]
        want[(r.doc_id, len(words), len(base), min(begins, default=None), max(begins, default=None), ",".join(sorted({d[3] for d in base})), ",".join(sorted({d[3] for d in base + stays})), max([d[5] for d in stays], default=0.0))] += 1
    got = Counter(tuple(r) for r in license_scan.scanned(rows).drop("detections").collect())
    assert got == want


def test_every_rule_can_match_and_holds_an_anchor():
    assert len(license_rules.rules()) >= 200
    for r in license_rules.rules():
        re.compile(license_scan.over_words(r.pattern))
        assert r.keyword in re.sub(r"[()?:|]", " ", r.pattern).replace("[sc]", "s").split() or r.keyword in r.pattern


def alternatives(pattern):
    """Every text that the pattern matches (its groups, alternatives, ? and [..] written out)."""

    def branches(i):
        out, ends = [], [""]
        while i < len(pattern) and pattern[i] != ")":
            if pattern[i] == "|":
                out, ends, i = out + ends, [""], i + 1
                continue
            if pattern.startswith("(?:", i):
                part, i = branches(i + 3)
                i += 1
            elif pattern[i] == "[":
                part, i = list(pattern[i + 1 : pattern.index("]", i)].replace("0-9", "7")), pattern.index("]", i) + 1
            else:
                part, i = [pattern[i]], i + 1
            if pattern[i : i + 1] == "?":
                part, i = ["", *part], i + 1
            ends = [a + b for a in ends for b in part]
        return out + ends, i

    return branches(0)[0]


def test_each_alternative_alone_is_detected(spark):
    wanted = []
    for r in license_rules.rules():
        texts = alternatives(r.pattern)
        assert all(re.fullmatch(r.pattern, t) for t in texts)
        for t in texts:
            assert r.keyword in t.split(), (r, t)
            assert any(a in t for a in license_rules.ANCHORS), (r, t)
        wanted += [(t, r.label, r.confidence) for t in sorted(texts, key=lambda t: (len(t.split()), t))[:: max(1, len(texts) // 12)]]
    phrases = [("Expat License", "mit"), ("the FreeBSD license", "bsd-2-clause"), ("for non-commercial use only", "non-commercial"), ("Creative Commons Attribution Non-Commercial", "cc-by-nc")]
    wanted += [(t, label, 0.6) for t, label in phrases]
    texts = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(wanted)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scanned(texts).collect()}
    for i, (t, label, confidence) in enumerate(wanted):
        found = license_scan_labels(t)
        assert got[i]["score"] >= confidence and set(got[i]["labels"].split(",")) == found, (t, got[i])
    for i, (_, label) in enumerate(phrases, len(wanted) - len(phrases)):
        assert got[i]["labels"] == label


def license_scan_labels(text):
    _, base, stays = plain_detections(text)
    return {d[3] for d in base + stays}


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_and_base(spark, docs):
    rows = docs.union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("x").alias("n_words")))
    got = Counter(tuple(r) for r in quality_rules.judged(rows, []).collect())
    want = Counter()
    for r in rows.collect():
        s = plain_statistics(r.text)
        failed = s[0] < 10 or 100 * s[4] > 20 * s[0]
        want[(r.doc_id, *s, failed, not failed)] += 1
    assert got == want


def test_rules_learn_the_labels_and_are_one_case_expression(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.rules_from(docs, labels)
    assert rules and len(rules) <= quality_rules.MOST_RULES
    out = quality_rules.judged(docs, rules)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in got}
    assert share[1] >= 0.99 and share.get(0, 0) <= 0.1


def test_no_labels_or_no_rows(spark, docs):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    assert quality_rules.rules_from(docs, labels) == []
    empty = docs.limit(0)
    assert quality_rules.rules_from(empty, labels) == []
    assert quality_rules.judged(empty, []).count() == 0 and license_scan.scanned(empty).count() == 0


def test_a_filter_costs_no_second_reading(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.rules_from(docs, labels)
    judged = quality_rules.judged(docs, rules)
    for condition in ("kept", "not base_failed", "n_repeat_words > 0 and n_words > 30"):
        plan = judged.where(condition)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") <= 4  # of the text once each: blanks, symbols, capitals, shouts
    whole = judged.collect()
    assert sorted(map(tuple, judged.where("kept").collect()), key=str) == sorted((tuple(r) for r in whole if r.kept), key=str)


def plain_rule_holds(rule, row):
    return all(row[c.feature] >= c.limit if c.above else row[c.feature] < c.limit for c in rule)


def test_learned_list_covers_what_it_says(spark):
    """Each rule's precision, recounted plainly over the rows that the rules before it left, reaches the least one."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    stats = quality_rules.with_statistics(docs).join(labels.where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id")
    held = (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(3)) == 0).alias("held")
    rows = [r.asDict() for r in stats.select(*quality_rules.FEATURES, "label", held).collect()]
    rules = quality_rules.learn(stats.select(*quality_rules.FEATURES, "label", held))
    assert rules
    for rule in rules:
        covered = [r for r in rows if plain_rule_holds(rule, r)]
        for part in (True, False):
            own = [r for r in covered if r["held"] == part]
            assert sum(r["label"] == 0 for r in own) >= quality_rules.LEAST_PRECISION * len(own)
        assert sum(r["label"] == 0 and not r["held"] for r in covered) >= quality_rules.LEAST_ROWS
        rows = [r for r in rows if not plain_rule_holds(rule, r)]


def test_many_detections_in_one_text(spark):
    import time

    docs = spark.createDataFrame([(1, "mit license and " * 25_000), (2, "the apache license version 2 0 all rights reserved " * 4_000)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in license_scan.scanned(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "labels", F.size("detections").alias("n")).collect()}
    assert time.time() - began < 60
    assert got[1].n_base == 25_000 and got[1].last_word == 3 * 24_999 and got[1].n == 25_000 and got[1].labels == "mit"
    assert got[2].n_base == 4_000 and "apache-2.0" in got[2].labels.split(",") and got[2].n == 8_000
