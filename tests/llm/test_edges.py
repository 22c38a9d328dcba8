"""Edge cases of search, near copies, toxicity, language and mixing, and brute-force checks."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendspark.llm import cover_tree, language_id, mixing, ngram_join, toxicity
from trendspark.llm.common import id_crc, table

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, size string, score string"
LONG = "word " * 200_000


# --- exact search


def plain_search(rows, is_query, k):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for q, v in {(i, tuple(v)) for i, v in whole if is_query(i)}:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))
        out.update((q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1))
    return out


def test_search_equals_brute_force(spark):
    draw = random.Random(5)
    centres = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(i, [c + draw.gauss(0, 0.1) for c in draw.choice(centres)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(50)]  # a group of equal vectors: ties go to smaller ids
    rows += [(None, [1.0] * 6), (500, None), (505, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (510, [float("nan")] * 6), (515, [float("inf")] * 6), (520, [0.5, 0.5]), (525, [0.25, 1.0]), (530, [0.0] * 6), (10, rows[10][1]), (10, rows[11][1])]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, v string, rank int")
    want = plain_search(rows, lambda i: i % 5 == 0, 5)
    for blocks in ({}, {"block_rows": 60, "query_rows": 25}):
        found = cover_tree.top_k(vectors, F.col("vec_id") % 5 == 0, **blocks)
        assert found.columns == ["query_id", "rank", "vec_id", "score"]
        assert Counter(map(tuple, found.collect())) == want


def test_search_with_a_row_that_repeats(spark):
    draw = random.Random(6)
    rows = [(i, [draw.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    hot = [(61, [2.0, 2.0, 2.0, 2.0])] * 3 + [(62, [1.5, 1.5, 1.5, 1.5])] * 4000 + [(65, [1.0, 1.0, 1.0, 1.0])] * 4000
    vectors = spark.createDataFrame(rows + hot, "vec_id long, embedding array<double>")
    want = plain_search(rows + hot, lambda i: i % 5 == 0, 5)
    found = cover_tree.top_k(vectors, F.col("vec_id") % 5 == 0, block_rows=60, query_rows=25)
    assert Counter(map(tuple, found.collect())) == want
    sent = cover_tree.at_most(cover_tree.integer_vectors(vectors), 5).groupBy("vec_id").count()
    assert {r["vec_id"]: r["count"] for r in sent.collect()} == {i: 1 for i in range(60)} | {61: 3, 62: 5, 65: 5}


def test_search_with_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert cover_tree.top_k(spark.createDataFrame([], kind), F.col("vec_id") % 5 == 0).count() == 0
    assert cover_tree.top_k(spark.createDataFrame([(0, [1.0])], kind), F.col("vec_id") % 5 == 0).count() == 0
    two = cover_tree.top_k(spark.createDataFrame([(0, [1.0]), (1, [0.5])], kind), F.col("vec_id") % 5 == 0)
    assert list(map(tuple, two.collect())) == [(0, 1, 1, 256 * 128)]


@pytest.mark.parametrize("largest", [9, 3_000_000_000, 2**61])  # the last two saturate or need whole numbers beyond doubles
def test_walk_equals_brute_force(largest):
    low, high = cover_tree.LONG.min, cover_tree.LONG.max
    draw = np.random.default_rng(1)
    for t in range(12):
        n = int(draw.integers(1, 300))
        pool = draw.integers(-largest, largest, (max(1, n // (1 + t % 4 * 8)), int(draw.integers(1, 5))))  # equal rows
        rows, ids = pool[draw.integers(0, len(pool), n)], draw.integers(0, max(2, n // (1 + t % 2 * 6)), n)  # repeated ids
        asked = np.unique(np.column_stack([ids, rows])[: max(1, n // 3)], axis=0)
        search = cover_tree.Search(asked[:, 1:], asked[:, 0], rows, ids, 5)
        for j, (i, *v) in enumerate(asked.tolist()):
            want = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), low), high), c) for c, w in zip(ids.tolist(), rows.tolist(), strict=True) if c != i)[:5]
            m = search.count[j]
            assert list(zip((-s for s in search.score[j, :m].tolist()), search.found[j, :m].tolist(), strict=True)) == want


# --- near copies


def plain_near_copies(rows):
    """(doc_id, size, component_id) by comparing all pairs; ids are unique."""
    sets = {}
    for i, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
        words = [w for w in words if w]
        sets[i] = {tuple(words[a : a + 5]) for a in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return Counter((i, len(sets[i]), find(i)) for i in ids)


def near_texts(seed):
    """Groups of copies with changed words around the limit, chains, shared passages and odd texts."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = draw.choices(words, k=60)
    texts = [None, "", " \t\n", "one", "One", "one two", "ONE TWO", "one\ttwo three four", "a b c d e", "A b c d e", "Ä b c d e", "ä b c d e"]
    for size, copies, most in ((40, 12, 3), (200, 60, 12), (90, 40, 6), (400, 25, 20), (12, 10, 1)):
        base = draw.choices(words, k=size)
        texts.append(" ".join(base))
        for _ in range(copies):
            own = list(base)
            for at in draw.sample(range(size), draw.randint(0, most)):
                own[at] = draw.choice(words)
            texts.append(" ".join(own))
        for part in range(1, 6):  # a chain: each drops more of the end
            texts.append(" ".join(base[: size - part * size // 12]))
    for _ in range(60):  # a passage that many texts share, from a small to a large part of each
        own = draw.choices(words, k=draw.randint(2, 200))
        texts.append(" ".join(own + passage))
    texts += [" ".join(passage)] * 5
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_copies_equal_brute_force(spark, seed):
    rows = near_texts(seed)
    docs = spark.createDataFrame([(i, t, "n", "n", "n", "n") for i, t in rows], COLUMNS).repartition(3)
    assert Counter(map(tuple, ngram_join.near_copies(docs).collect())) == plain_near_copies(rows)


def test_near_copies_edges(spark):
    assert ngram_join.near_copies(spark.createDataFrame([], COLUMNS)).count() == 0
    rows = [(None, "a b c d e f", *"xxxx"), (7, "a b c d e f", *"xxxx"), (7, "a b c d e f", *"xxxx"), (9, LONG, *"xxxx"), (8, LONG, *"xxxx"), (None, None, *"xxxx")]
    docs = spark.createDataFrame(rows, COLUMNS)
    assert Counter(map(tuple, ngram_join.near_copies(docs).collect())) == Counter([(None, 2, 7), (7, 2, 7), (7, 2, 7), (9, 1, 8), (8, 1, 8), (None, 0, None)])
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([7, 8, None])


# --- toxicity and language: held-out rows, and rows that say nothing

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "123 456 !!!"), (5, LONG), (6, "twice"), (6, "twice"), (None, "no id")]


def odd(spark):
    return spark.createDataFrame([(i, t, None, None, "n", "n") for i, t in ODD], COLUMNS)


def test_toxicity(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.learn(docs, labels, keep=id_crc() % 3 != 1)
    held = labels.where(id_crc() % 3 == 1).where("toxic is not null").select("doc_id", "toxic")
    right = toxicity.scored(docs, model).join(held, "doc_id").select((F.col("predicted") == F.col("toxic")).cast("int").alias("right")).agg(F.avg("right")).first()[0]
    assert right >= 0.95
    found = toxicity.scored(odd(spark), model).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= toxicity.THRESHOLD) for r in found)
    assert toxicity.accepted(odd(spark), model).columns == odd(spark).columns
    assert toxicity.scored(spark.createDataFrame([], COLUMNS), model).count() == 0


def plain_contexts(symbols, use=("target", "negation", "report", "target after", "negation after", "report after", "insult", "threat")):
    """The contexts of a clause's words, read off the definitions."""
    T = toxicity
    out = []
    for i, s in enumerate(symbols):
        before, after = symbols[:i], symbols[i + 1 :]
        named = T.TARGET in before and "target" in use or T.TARGET in after and "target after" in use
        negated = T.NEGATION in before[-T.NEGATION_REACH :] and "negation" in use or T.NEGATION in after[: T.NEGATION_AFTER] and "negation after" in use
        said = T.REPORT in before and "report" in use or T.REPORT in after and "report after" in use
        accepted = s == T.INSULT and "insult" in use or s == T.THREAT and "threat" in use and named
        out.append(-1 if not accepted else T.REPORTED if said else T.NEGATED if negated else T.AIMED if named else T.PLAIN)
    return out


def test_composed_machine_equals_a_plain_reading():
    draw = random.Random(4)
    clauses = [[draw.choice([0, 1, 2, 3, 4, 5, 5, 5]) for _ in range(draw.randint(0, 9))] for _ in range(4000)]
    machine = toxicity.Machine(*toxicity.grammar())
    assert len(machine.left) > 8 and len(machine.right) > 4
    whole = [machine.read(c) for c in clauses]
    assert whole == [plain_contexts(c) for c in clauses]
    silent = toxicity.Transducer(1, {})
    every = ("target", "negation", "report", "target after", "negation after", "report after", "insult", "threat")
    for side, names in enumerate((("insult", "threat", "target", "negation", "report"), ("target", "negation", "report"))):
        for name in names:  # without any one of the transducers some clause reads differently
            parts = [dict(p) for p in toxicity.grammar()]
            parts[side][name] = silent
            less = [toxicity.Machine(*parts).read(c) for c in clauses]
            gone = name if side == 0 else name + " after"
            assert less != whole and less == [plain_contexts(c, tuple(u for u in every if u != gone)) for c in clauses]


def test_word_classes_are_learned(spark):
    draw = random.Random(8)
    filler = [f"word{i}" for i in range(200)]
    say = lambda *own: " ".join([*draw.sample(filler, 2), *own, *draw.sample(filler, 2)])
    rows = []
    for _ in range(60):
        rows += [(say("zorbish"), 1), (say("you", "gonna", "grindle"), 1), (say("ploogers", "zorbish"), 1), (say("hardly", "zorbish"), 0)]
        rows += [(say("recounted", *draw.sample(filler, 4), "zorbish"), 0), (say("hello"), 0), (say("grindle"), 0) if draw.random() < 0.02 else (say("you"), 0)]
    rows += [(say(*draw.sample(filler, 5)), 0) for _ in range(400)] + [(say("zorbish"), 1) for _ in range(500)] + [(say("you", "grindle"), 1) for _ in range(60)]
    texts = spark.createDataFrame(rows, "text string, label int")
    words = toxicity.lexicon(texts)
    assert {w.rstrip("$")[:4] for w in words} >= {"zorb", "grin"}
    threats, learned = toxicity.word_classes(texts, toxicity.Model(words))
    assert {t.rstrip("$")[:4] for t in threats} == {"grin", "gonn"}  # which stands in those clauses only
    assert learned["hardly"] == toxicity.NEGATION and learned["recounted"] == toxicity.REPORT
    assert "hello" not in learned and "you" not in learned


def test_toxicity_without_labels(spark):
    docs = odd(spark)
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(docs, model).where("score between 0 and 1").count() == len(ODD)


def test_language(spark):
    docs = table(spark, SF, "documents")
    model = language_id.learn(docs, keep=id_crc() % 5 != 0)
    held = docs.where(id_crc() % 5 == 0).where("lang is not null").select("doc_id", "lang")
    found = language_id.predicted(docs, model).join(held, "doc_id").where("lang_pred <> 'und'")
    assert found.select((F.col("lang") == F.col("lang_pred")).cast("int").alias("right")).agg(F.avg("right")).first()[0] >= 0.95
    by_id = [(r["doc_id"], r["lang_pred"] == "und") for r in language_id.predicted(odd(spark), model).collect()]
    assert Counter(by_id) == Counter([(1, True), (2, True), (3, True), (4, True), (5, False), (6, False), (6, False), (None, False)])
    assert language_id.accepted(odd(spark), model).columns == odd(spark).columns
    assert language_id.predicted(spark.createDataFrame([], COLUMNS), model).count() == 0


def test_repeated_rows_teach_once(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    seen, real = [], language_id.fitted
    monkeypatch.setattr(language_id, "fitted", lambda spark, x, names, *rest: seen.append((len(x), sorted(names))) or real(spark, x, names, *rest))
    language_id.learn(docs)
    one = docs.where("lang = 'en' and length(text) > 200").orderBy("doc_id").limit(1)
    many = docs.union(one.crossJoin(spark.range(6000)).select("doc_id", "text", "lang")).repartition(8)
    language_id.learn(many)
    assert seen[0] == seen[1] and seen[0][0] <= 3 * docs.count()
    plan = many.select("doc_id", "lang").groupBy("lang").count()._jdf.queryExecution().toString()
    assert "Window" not in plan


def plain_vote(model, margin):
    """Family, then language, by counting won pairs."""
    def winner(step, of):
        won = {k: (0, 0.0) for k in of}
        for (kind, p, q), m in zip(model.pairs, margin, strict=True):
            if kind == step and p in won and q in won:
                won[p] = won[p][0] + (m > 0), won[p][1] + m
                won[q] = won[q][0] + (m < 0), won[q][1] - m
        return sorted(of, key=lambda k: (-won[k][0], -won[k][1], k))[0]

    family = winner("family", sorted(set(model.family)))
    return model.languages[winner("language", [k for k, f in enumerate(model.family) if f == family])]


def test_prediction_equals_a_plain_vote(spark):
    docs = table(spark, SF, "documents")
    model = language_id.learn(docs, keep=id_crc() % 5 != 0)
    texts = [r.text for r in docs.where("text is not null").orderBy("doc_id").limit(120).collect()]
    found = model.predict(texts)
    x, letters, n = language_id.gram_counts(texts)
    for t, (lang, score, near), row, known, grams in zip(texts, found, x, letters, n, strict=True):
        assert known == any(c.isalpha() for c in t) and 0 <= score <= 1
        if known:
            margin = [float(sum(v * s * w for v, s, w in zip(row.tolist(), model.scale.tolist(), model.weights[:, k].tolist(), strict=True) if v)) + float(model.bias[k]) for k in range(len(model.pairs))]
            if min(map(abs, margin)) > 1e-3:
                assert lang == plain_vote(model, margin)


def test_language_with_nothing_to_learn(spark):
    model = language_id.learn(odd(spark))
    assert language_id.predicted(odd(spark), model).where("lang_pred = 'und'").count() == len(ODD)


# --- mixing


def test_mixing(spark):
    rows = [(i, f"text {i}", "en", "big" if i % 10 else "small", "n", "n") for i in range(2000)] + [(5000, None, None, None, "n", "n"), (None, "", "en", "big", "n", "n")]
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("copy", F.lit("mine"))
    mixed = mixing.mixed(docs, {"big": 1.0, "small": 3.0})
    n = Counter(r["source"] for r in mixed.collect())
    assert set(n) == {"big", "small"} and 0.7 <= n["small"] / sum(n.values()) <= 0.8
    assert mixed.columns[: len(docs.columns)] == docs.columns and mixed.where("copy <> 'mine'").count() == 0
    again = mixing.mixed(docs.repartition(7), {"big": 1.0, "small": 3.0})
    assert again.exceptAll(mixed).count() == 0 and mixed.exceptAll(again).count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_mix_is_in_global_order_without_sampling(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 3}", "n", "n") for i in range(3000)], COLUMNS)
    mixed = mixing.mixed(docs, {"s0": 1.0, "s1": 2.0, "none such": 1.0, "s2": 0.0})
    got = [(r["place"], r["doc_id"], r["copy"]) for r in mixed.collect()]
    assert got == sorted(got) and abs(len(got) - 2000) < 300 and 0 <= got[0][0] < got[-1][0] < 1
    sizes = [r["count"] for r in mixed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 1.5 * min(sizes)
    assert "rangepartitioning" not in mixed._jdf.queryExecution().toString()


def plain_poisson(u, rate):
    """The least k with u < P(X <= k), by exact terms from far below the mean."""
    k = max(0, math.floor(rate - 14 * math.sqrt(rate) - 30))
    term = lambda k: math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
    total = term(k)
    while u >= total:
        k += 1
        total += term(k)
    return k


def test_poisson_counts_at_any_rate(spark):
    pairs = [(u, rate) for rate in (0.05, 1.0, 7.5, 199.0, 200.0, 201.0, 390.0, 800.0, 5000.0, 100_000.0) for u in (0.0, 1e-6, 0.01, 0.3, 0.5, 0.77, 0.999, 0.9999)]
    table = spark.createDataFrame(pairs, "u double, rate double")
    for r in table.select("u", "rate", mixing.poisson_count(F.col("u"), F.col("rate")).alias("k")).collect():
        want = plain_poisson(r.u, r.rate) if r.u else max(0, r.k)
        assert r.k == want, r
        assert r.u or r.k <= max(0, r.rate - 11 * math.sqrt(r.rate))


def test_mixing_of_a_source_with_few_documents(spark):
    rows = [(i, "many", "en", "many", "n", "n") for i in range(40_000)] + [(100_000 + i, "few", "en", "few", "n", "n") for i in range(4)]
    mixed = mixing.mixed(spark.createDataFrame(rows, COLUMNS))
    found = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id", "copy").alias("own")).collect()
    n = {r["source"]: r["n"] for r in found}
    assert abs(n["few"] - 20_002) < 6 * math.sqrt(20_002) and abs(n["many"] - 20_002) < 6 * math.sqrt(20_002)
    assert all(r["n"] == r["own"] for r in found)
    copies = mixed.where("source = 'few'").groupBy("doc_id", "n_copies").agg(F.count(F.lit(1)).alias("n"), F.max("copy").alias("last")).collect()
    assert len(copies) == 4 and all(r["n"] == r["n_copies"] == r["last"] + 1 for r in copies)
    blocks = mixing.mixed(spark.createDataFrame(rows[-1:] + [(i, "m", "en", "many", "n", "n") for i in range(60_000)], COLUMNS)).where("source = 'few'")
    assert blocks.count() == blocks.select("copy").distinct().count() == blocks.first()["n_copies"] > 2 * mixing.COPIES_A_BLOCK


# --- languages that were never learned

STRANGE = [
    "Все люди рождаются свободными и равными в своем достоинстве и правах", "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια",
    "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待" * 3, "xkqz wvjq zzxk qpwv jxqk vbnq xzwk qjjv kxzq " * 5,
]


def test_accepted_rejects_what_was_never_learned(spark):
    docs = table(spark, SF, "documents")
    for languages in (["en"], ["de", "en", "fr", "es"]):
        own = docs.where(F.col("lang").isin(languages))
        model = language_id.learn(own, keep=id_crc() % 5 != 0)
        assert math.isfinite(model.limit)
        clean = own.where(id_crc() % 5 == 0).select("doc_id", "text")
        short = clean.select("doc_id", F.array_join(F.slice(F.split("text", r"\s+"), 1, 8), " ").alias("text")).where("length(text) > 30")
        # of English alone, two held-out texts quote a language that was not learned at length
        assert language_id.accepted(clean, model).count() >= (1 if len(languages) > 1 else 0.98) * clean.count()
        assert language_id.accepted(short, model).count() >= 0.97 * short.count()
        strange = spark.createDataFrame(list(enumerate(STRANGE)), "doc_id long, text string")
        assert [r["doc_id"] for r in language_id.accepted(strange, model).collect()] == []
        assert language_id.predicted(strange, model).count() == len(STRANGE)


def test_more_than_64_languages_are_all_learned(spark):
    draw = random.Random(11)
    names = [f"{codes[0]}-{k}" for codes in language_id.FAMILIES.values() for k in range(5)] + ["xx1", "xx2"]
    rows = []
    for name in names:
        words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(3, 8))) for _ in range(15)]
        rows += [(len(rows) + i, " ".join(draw.choice(words) for _ in range(40)), name, "s", "n", "n") for i in range(12)]
    docs = spark.createDataFrame(rows, COLUMNS)
    model = language_id.learn(docs, keep=F.col("doc_id") % 3 != 0)
    assert model.languages == sorted(names) and len(names) == 67 and len(model.pairs) > language_id.DRIVER_PAIRS
    found = language_id.predicted(docs.where("doc_id % 3 = 0"), model).join(docs, "doc_id").select("lang", "lang_pred").collect()
    assert {r["lang_pred"] for r in found} == set(names)
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)
