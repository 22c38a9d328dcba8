"""Token operators against the libraries themselves, and exact round trips."""

import os
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from trendspark.llm import bpe_codec, pieces, token_counts, token_frames, vocab

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SF = "/root/testdata/sf0.01"
LETTERS = "ab's'tvelmdrLLé5½² \n\t 　\x1c\x85!?_-\U0001f642ßñ'"
EDGES = [None, "", " ", "\n\n", "a" * 5000, "ab " * 4000, "don't 'tis it's'll x're", "x<|endoftext|> y", "<|endoftext|><|endoftext|>", "same", "same", "Ḱ \x00 z"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7) for i, t in enumerate(EDGES)] + [(3, "again", 7), (None, "no id", 7), (None, None, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").union(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150").select(F.col("doc_id") + 1000, "text", F.lit(7)))


def random_texts(n=4000, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 30))) for _ in range(n)]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab.default_path("byte_bpe_50k.json"))


def test_pieces_are_those_of_the_pattern():
    import public_tokenizers

    pattern, texts = regex.compile(public_tokenizers.PATTERN), random_texts()
    cut = pieces.Pieces(texts)
    got = [[] for _ in texts]
    for w, t in zip(cut.which, cut.text, strict=True):
        got[t].append(cut.different[w])
    assert got == [pattern.findall(t) for t in texts]


def test_pieces_with_colliding_hashes(monkeypatch):
    monkeypatch.setattr(pieces, "BASES", (1 << 63 | 1, 3))  # a weak hash, and one that notices
    texts = random_texts(300)
    cut = pieces.Pieces(texts)
    assert "".join(cut.different[w] for w in cut.which) == "".join(texts)


def test_counts_are_the_library_s(spark, docs):
    tok = library()
    got = Counter(tuple(r) for r in token_counts.token_counts(docs).collect())
    want = Counter()
    for r in docs.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want[(r.doc_id, len((r.text or "").encode()), n, n > 512)] += 1
    assert got == want


def test_merging_overlapping_pairs():
    tok, texts = library(), ["a" * n for n in range(1, 40)] + ["ababab" * 9, "aabaabaab", "....." * 7]
    rules = vocab.merges(vocab.default_path("byte_bpe_50k.json"))
    assert token_counts.merged_sizes([t.encode() for t in texts], rules).tolist() == [len(tok.encode(t).ids) for t in texts]


def test_a_full_cache_changes_nothing():
    path, texts = vocab.default_path("byte_bpe_50k.json"), random_texts(200)
    want = token_counts.count_texts(texts, path, pieces.Bounded()).tolist()
    small = pieces.Bounded(50)
    assert [token_counts.count_texts([t], path, small)[0] for t in texts] == want


def test_codec_is_tiktoken_s(spark, docs):
    import public_tokenizers
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks(vocab.default_path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = Counter(tuple(r) for r in bpe_codec.round_trip(docs).collect())
    want = Counter()
    for r in docs.collect():
        ids = own.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((r.text or "").encode()).hexdigest())] += 1
    assert got == want


def test_perfect_hash_is_minimal_and_heap_is_plain_merging():
    ranks = vocab.ranks(vocab.default_path("byte_bpe_50k.tiktoken"))
    words = sorted(ranks, key=ranks.__getitem__)[:3000]
    table = bpe_codec.PerfectHash(words)
    assert sorted(table.token.tolist()) == list(range(3000)) and table.candidates(words) == list(range(3000))

    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:] + [b"\xff" * 40], strict=True)))
            if best[0] == 1 << 30:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    r = random.Random(5)
    for _ in range(400):
        word = bytes(r.choice(b"aabeinst \xc3\xa9") for _ in range(r.randint(1, 24)))
        assert bpe_codec.heap_merge(word, ranks) == plain(word)


def test_codec_keeps_little_for_each_known_word():
    import tracemalloc

    r = random.Random(7)
    codec = bpe_codec.Codec(vocab.default_path(bpe_codec.VOCABULARY))
    words = [[" " + "".join(r.choice("abdeinorst") for _ in range(7)) for _ in range(3000)] for _ in range(15)]
    codec.encode(["".join(words[0])])
    tracemalloc.start()
    for some in words[1:]:
        flat, size = codec.encode(["".join(some)])
        assert codec.decode(flat.tolist()) == "".join(some).encode() and size.tolist() == [len(flat)]
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 100 * len({w for some in words[1:] for w in some})


def test_known_words_under_colliding_hashes_and_when_full():
    known = bpe_codec.Known(most=100, most_bytes=400)
    truth, words = {}, [b"%d" % i for i in range(90)]
    for some in (words[:30], words[20:60], words[:60], words[60:]):
        hashes = np.array([int(w) % 7 for w in some], np.uint64)  # most words share theirs with others
        got = known.get(some, hashes)
        assert all(x is None or x == truth[w] for w, x in zip(some, got, strict=True)) and (some is not words[:60] or any(got))
        new = [k for k, x in enumerate(got) if x is None]
        truth |= {some[k]: some[k] * 4 for k in new}
        known.put([some[k] for k in new], hashes[new], [some[k] * 4 for k in new])
        assert len(known) <= 100 and len(known.words) <= 400
    own = np.arange(90, dtype=np.uint64)
    known.clear()
    known.put(words[::-1], own[::-1], [w * 4 for w in words[::-1]])
    assert known.get(words, own) == [w * 4 for w in words] and known.get([b"x"], own[5:6]) == [None]


def frames_of(rows, tok):
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    return [(r.doc_id, np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for r in order]


def test_frames_read_back(spark, docs, tmp_path):
    found = token_frames.write_frames(docs, folder=f"file://{tmp_path}/frames", shards=5)
    got = token_frames.read_frames(found).orderBy("start").collect()
    want = frames_of(docs.collect(), library())
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter(want)
    assert [r.doc_id for r in got] == [w[0] for w in want]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    some = token_frames.read_frames(found, [1005, 1100, 99999]).collect()
    assert sorted(r.doc_id for r in some) == [1005, 1100]


def test_a_reader_opens_only_what_it_needs_and_sees_damage(tmp_path):
    import zstandard

    path = tmp_path / "one.zst"
    with open(path, "wb") as f:
        w = token_frames.FrameWriter(f, frame_ids=10)
        for i in range(50):
            w.add(i, np.arange(i, dtype="<u4").tobytes())
        w.close()
    with open(path, "rb") as f:
        reader = token_frames.FrameReader(f, path.stat().st_size)
        opened, plain = [], reader.frame
        reader.frame = lambda k: opened.append(k) or plain(k)
        assert reader.tokens(7) == np.arange(7, dtype="<u4").tobytes() and len(set(opened)) <= 2
        assert all(reader.tokens(i) == np.arange(i, dtype="<u4").tobytes() for i in range(50))
    raw = path.read_bytes()
    every = b"".join(np.arange(i, dtype="<u4").tobytes() for i in range(50))
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read(len(every)) == every
    path.write_bytes(raw[:20] + bytes([raw[20] ^ 1]) + raw[21:])
    with open(path, "rb") as f, pytest.raises((ValueError, zstandard.ZstdError)):
        reader = token_frames.FrameReader(f, path.stat().st_size)
        [reader.tokens(i) for i in range(50)]


def test_empty_tables(spark, docs, tmp_path):
    empty = docs.limit(0)
    assert token_counts.token_counts(empty).count() == 0 and bpe_codec.round_trip(empty).count() == 0
    assert token_frames.read_frames(token_frames.write_frames(empty, folder=f"file://{tmp_path}/none")).count() == 0
