"""SimHash near copies, fill-in-middle and spelling variants against plain readings."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trendspark.llm import fill_middle, links, simhash, spelling
from trendspark.llm.common import table

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, word string, point string, n string, guest int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in rows], KIND)


def least_labels(nodes, pairs):
    label = {x: x for x in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


# --- components


def test_components_equal_union_find(spark):
    draw = random.Random(2)
    pairs = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1400)] + [(draw.randrange(2000, 3000), draw.randrange(2000, 3000)) for _ in range(500)] + [(5000, 5000)]
    draw.shuffle(pairs)
    want = least_labels({x for p in pairs for x in p}, pairs)
    found = links.components(spark.createDataFrame(pairs, "a long, b long").repartition(5))
    assert {r.node: r.label for r in found.collect()} == {x: y for x, y in want.items() if x != 5000}
    assert links.components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_trees_have_few_children_each():
    groups = links.Groups()
    for i in range(1, 5000):
        groups.join(0, i)
    one, two = groups.trees()
    assert len(two) == 4999 and max(Counter(one).values()) <= links.FAN


# --- fingerprints


def plain_fingerprint(text):
    words = re.findall("[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_simhash(rows):
    points = [(i, plain_fingerprint(t)) for i, t in rows]
    pairs = [(a, b) for k, (a, x) in enumerate(points) for b, y in points[:k] if (x ^ y).bit_count() <= 3]
    label = least_labels([i for i, _ in points], pairs)
    return Counter((i, f"{x:016x}", label[i]) for i, x in points)


def copies(seed, n):
    draw = random.Random(seed)
    vocabulary = ["w" + str(k) for k in range(400)] + ["É e", "İ", "A b", "𝒳", "\x00"]
    texts = []
    for _ in range(n):
        if texts and draw.random() < 0.6:
            words = draw.choice(texts).split(" ")
            for _ in range(draw.choice([0, 0, 1, 2])):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(draw.choices(vocabulary, k=draw.choice([1, 2, 3, 40, 200]))))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash_equals_all_pairs(spark, seed):
    rows = list(enumerate([*copies(seed, 250), None, "", " \t\n\x0b\x0c\r ", "One  TWO", "one two", "Word " * 60_000]))
    found = simhash.near_copies(documents(spark, rows).repartition(4))
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, found.collect())) == plain_simhash(rows)


def test_simhash_with_repeated_and_null_ids_and_no_rows(spark):
    rows = [(7, "a b c d"), (7, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "e f g"), (9, None), (4, "")]
    out = Counter((r.doc_id, r.component_id) for r in simhash.near_copies(documents(spark, rows)).collect())
    assert out == Counter([(7, 3), (7, 3), (3, 3), (None, 3), (None, None), (9, 4), (4, 4)])
    assert simhash.near_copies(documents(spark, [])).count() == 0


def close_points(seed, n):
    """Random points, dense balls around some of them, and chains."""
    draw = np.random.default_rng(seed)
    points = draw.integers(0, 1 << 63, n // 4, dtype=np.uint64) * np.uint64(2) + draw.integers(0, 2, n // 4, dtype=np.uint64)
    out = [points]
    for centre in points[:3]:
        flips = draw.integers(0, 64, (n // 4, 3), dtype=np.uint64)
        out.append(centre ^ np.bitwise_or.reduce(np.uint64(1) << flips, axis=1))
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize("shards", [1, 4, 32])
def test_every_near_pair_meets_in_a_shard(shards):
    points = close_points(shards, 1500)
    tree = simhash.VantageTree(points[::3], leaves=shards)
    assert tree.n_leaves <= shards
    near = {(a, b) for a in range(len(points)) for b in np.flatnonzero(np.bitwise_count(points ^ points[a]) <= 3).tolist() if a < b}
    met, homes = set(), Counter()
    for _, home, visit in tree.walk(points, points[:0]):
        homes.update(home.tolist())
        here = set(home.tolist())
        both = here | set(visit.tolist())
        met |= {(a, b) for a, b in near if a in both and b in both and (a in here or b in here)}
    assert met == near and homes == Counter(range(len(points)))


def test_points_in_dense_balls_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 40)
    points = close_points(9, 3000)
    rows = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "point long").repartition(6)
    found = {r.node: r.label for r in links.components(simhash.near_points(rows)).collect()}
    signed = points.view(np.int64)
    pairs = [(int(signed[a]), int(signed[b])) for a in range(len(points)) for b in np.flatnonzero(np.bitwise_count(points ^ points[a]) <= 3).tolist() if a < b]
    want = least_labels(signed.tolist(), pairs)
    linked = {x for p in pairs for x in p}
    assert found == {x: want[x] for x in linked}
    one = simhash.Shard(points)
    assert len(one.own()[0]) < len(points) and len(one.visited(points)[0]) <= len(points)  # not all pairs of a dense ball


def test_equal_distances_do_not_split():
    ring = np.array([1 << k for k in range(1, 64)], np.uint64)  # all 2 apart
    tree = simhash.VantageTree(ring, size=4)
    assert sum(len(home) for _, home, _ in tree.walk(ring, ring[:0])) == len(ring)
    assert len(simhash.Shard(ring).own()[0]) == len(ring) - 1


# --- fill-in-middle


def plain_cut(doc_id, text):
    text = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "\r\n x\x85\n", "𝒳é\n" * 7 + "end", "x <P> y\nz", "<S>", "a\n<M", "<\n<P\n>S>\n", "M><S\n", "line of words\n" * 50_000 + "tail", "\x00\n\x00"]


def test_rearranged_equals_plain_cut(spark):
    rows = [(i, t) for i in [*range(40), None, -5, 2**62] for t in TEXTS[: 14 if i else 16]]
    out = fill_middle.rearranged(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out) == Counter((i, t or "", *plain_cut(i, t)) for i, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    for r in out:
        assert fill_middle.restored(r.output, r.form) == r.text
    assert fill_middle.rearranged(documents(spark, [])).count() == 0


def test_restored_reads_the_output_alone():
    assert fill_middle.restored("<P>a<S>c<M>b", "psm") == "abc" and fill_middle.restored("<S>c<P>a<M>b", "spm") == "abc"
    for bad in ("a<S>c<M>b", "<P>a<M>b", "<P>a<S>c", "<P>a<S>c<M>b<M>d"):
        with pytest.raises(ValueError):
            fill_middle.restored(bad, "psm")


def test_rates_and_other_units():
    pattern = fill_middle.compiled(r"\w+\s*|\W+")
    forms = Counter(fill_middle.cut(pattern, "one two three", i, seed=3, rate=40, spm=25)[1] for i in range(2000))
    assert abs(forms["plain"] - 1200) < 100 and abs(forms["spm"] - 200) < 60
    with pytest.raises(ValueError):
        fill_middle.cut(fill_middle.compiled("a"), "ab", 1)


def test_digests_of_the_given_table(spark):
    docs = table(spark, SF, "documents")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        *cut, output = plain_cut(r.doc_id, r.text)
        want[(r.doc_id, *cut, sha(output), sha(r.text or ""))] += 1
    assert Counter(map(tuple, fill_middle.digests(docs).collect())) == want


# --- spelling variants


def plain_words(rows, one_in=97, count=3, length=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if c >= count and len(w) >= length}


def edits(word, letters):
    cuts = range(len(word) + 1)
    out = {word[:i] + word[i + 1 :] for i in cuts[:-1]} | {word[:i] + c + word[i:] for i in cuts for c in letters}
    return (out | {word[:i] + c + word[i + 1 :] for i in cuts[:-1] for c in letters}) - {word}


def plain_variants(n):
    letters = sorted({c for w in n for c in w})
    near = {w: [x for x in edits(w, letters) if x in n] for w in n}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def test_variants_of_the_given_table(spark):
    docs = table(spark, SF, "documents")
    n = plain_words([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert len(n) > 2000
    found = spelling.variants(docs)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = found.collect()
    assert set(map(tuple, rows)) == plain_variants(n) and len(rows) == len(n)


@pytest.mark.parametrize("block", [3, 40])
def test_variants_of_dense_vocabularies_in_small_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "ROWS", 7)
    draw = random.Random(block)
    vocabulary = {"".join(draw.choices("abÿ", k=draw.randrange(5, 9))) for _ in range(400)}
    vocabulary |= {"aaaaa" + "a" * k for k in range(6)} | {"é" * 6, "abcdefgh" * 30, "abcdefgh" * 30 + "x"}
    n = {w: draw.choice([3, 3, 4, 6, 12, 24, 48]) for w in vocabulary}
    found = spelling.grouped(spark.createDataFrame(list(n.items()), "word string, n long").repartition(3))
    assert set(map(tuple, found.collect())) == plain_variants(n)


def test_words_of_odd_texts(spark):
    rows = [(1, "Hello HELLO hello wörld WÖRLD×wörld"), (None, "hello " * 3), (2, None), (3, ""), (4, "abcde" * 40_000 + " 1 " + "abcde" * 40_000), (5, "short shorİt abcdefg"), (5, "short short abcdefg"), (5, "abcdefg")]
    rows += [(i, "alphabet number") for i in range(10, 400)]
    found = {r.word: r.n for r in spelling.words(documents(spark, rows)).collect()}
    assert found == plain_words(rows)
    assert {r.word: r.n for r in spelling.words(documents(spark, rows), one_in=None, count=1).collect()} == plain_words(rows, one_in=2**33, count=1)
    assert spelling.variants(documents(spark, [])).count() == 0 and spelling.variants(documents(spark, [(1, "one")])).count() == 0


def test_typo_is_the_contract():
    for i, w in [(i, w) for i in range(300) for w in ("committee", "élan", "a")]:
        h = zlib.crc32(f"{i}:{w}".encode())
        assert spelling.typo(i, w) == (w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :])
