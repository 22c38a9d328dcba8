"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace: as many slots as
tokens, one comparison for each lookup) resolves pre-tokens that are tokens as a whole.
Tier two: other pre-tokens are merged by a heap of ranked pairs over a doubly linked list of
byte spans, so a pre-token of n bytes takes O(n log n). Results of different pre-tokens are
kept in a bounded cache of the Python worker, in flat arrays. Decoding concatenates the bytes of the ids.

There is no shuffle and no state between tasks but that cache; a worker holds the vocabulary, an Arrow
batch, about ``CHUNK_BYTES`` of its texts as Python strings, and at most ``KNOWN`` pre-tokens of about
50 bytes each.

Results: null text is empty (no ids, the hash of no bytes); texts of any length are encoded
whole; every input row gives one row, repeated ids included; a null id stays null; an empty
table gives an empty table; extra columns of the input are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trendspark.llm import pieces, vocab
from trendspark.llm.common import byte_texts, held, release

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK_BYTES = 1 << 19
KNOWN, KNOWN_BYTES = 200_000, 1 << 23  # entries of the cache, and bytes of their pre-tokens


def mixed(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """A 64-bit mix of hashes and displacements."""
    x = h ^ (np.uint64(0x9E3779B97F4A7C15) * (d.astype(np.uint64) + np.uint64(1)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash of the tokens: slot for each token, as many slots as tokens."""

    def __init__(self, tokens: list[bytes]):
        n = len(tokens)
        self.slots, self.buckets = n, 2 * n // 3 + 1
        h = self.hashes(tokens)
        if len(np.unique(h)) != n:
            raise ValueError("two tokens have the same hash")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        self.shift = np.zeros(self.buckets, np.int64)
        self.token = np.full(n, -1, np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(at)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[at[b] : at[b + 1]]
            if len(own) < 2:
                break
            for d in range(0, 1 << 30, 64):  # the first displacement that leads all keys of the bucket to free slots
                to = (mixed(h[own][:, None], np.arange(d, d + 64)) % np.uint64(n)).astype(np.int64)
                apart = (np.diff(np.sort(to, axis=0), axis=0) > 0).all(axis=0)
                good = np.flatnonzero((self.token[to] < 0).all(axis=0) & apart)
                if len(good):
                    self.shift[b], self.token[to[:, good[0]]] = d + good[0], own
                    break
        free = iter(np.flatnonzero(self.token < 0).tolist())
        for b in np.flatnonzero(sizes == 1):  # a lone key goes to any free slot, which is stored itself
            slot = next(free)
            self.shift[b], self.token[slot] = -slot - 1, order[at[b]]

    @staticmethod
    def hashes(words: list[bytes]) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def candidates(self, words: list[bytes], hashes: np.ndarray | None = None) -> list[int]:
        """For each word the only token that it can be."""
        h = self.hashes(words) if hashes is None else hashes
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -d - 1, (mixed(h, np.maximum(d, 0)) % np.uint64(self.slots)).astype(np.int64))
        return self.token[slot].tolist()


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: pairs in order of rank, from the left among equals."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if after[i] != j or end[j] != stop or end[i] != j:  # one of the two has changed since
            continue
        end[i], after[i] = stop, after[j]
        end[j] = -1
        if (k := after[i]) < n:
            before[k] = i
            if (r := ranks.get(word[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, k, end[k]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class Known:
    """A cache from pre-tokens to packed ids: sorted hashes, and the words and ids themselves one after the
    other, a quarter of what a dict of strings takes. A hash only says where to look; the words are
    compared. It is emptied when full."""

    def __init__(self, most: int = KNOWN, most_bytes: int = KNOWN_BYTES):
        self.most, self.most_bytes = most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.words, self.ids = bytearray(), bytearray()
        self.word_at, self.id_at = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.entry)

    def get(self, words: list[bytes], hashes: np.ndarray) -> list[bytes | None]:
        if not len(self):
            return [None] * len(words)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        e = self.entry[place]
        spans = zip(words, (self.hashes[place] == hashes).tolist(), *(x.tolist() for at in (self.word_at, self.id_at) for x in (at[e], at[e + 1])), strict=True)
        return [bytes(self.ids[c:d]) if same and self.words[a:b] == w else None for w, same, a, b, c, d in spans]

    def put(self, words: list[bytes], hashes: np.ndarray, ids: list[bytes]) -> None:
        if len(self) + len(words) > self.most or len(self.words) + sum(map(len, words)) > self.most_bytes:
            self.clear()
        order = np.argsort(hashes, kind="stable")
        to = np.searchsorted(self.hashes, hashes[order])
        self.entry = np.insert(self.entry, to, (len(self) + order).astype(np.int32))
        self.hashes = np.insert(self.hashes, to, hashes[order])
        ends = lambda at, parts: np.append(at, at[-1] + np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))))
        self.word_at, self.id_at = ends(self.word_at, words), ends(self.id_at, ids)
        self.words += b"".join(words)
        self.ids += b"".join(ids)


class Codec:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, path: str):
        self.ranks = vocab.ranks(path)
        self.tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        if [self.ranks[t] for t in self.tokens] != list(range(len(self.tokens))):
            raise ValueError("ids must run from 0 without a gap")
        self.whole = PerfectHash(self.tokens)
        self.known = Known()

    def merged(self, words: list[bytes], hashes: np.ndarray) -> list[bytes]:
        """Packed ids of each word."""
        found = zip(words, self.whole.candidates(words, hashes), strict=True)
        return [np.array([i] if self.tokens[i] == w else heap_merge(w, self.ranks), np.uint32).tobytes() for w, i in found]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        cut_up = pieces.Pieces(texts)
        words = [w.encode() for w in cut_up.different]
        hashes = self.whole.hashes(words)
        ids = self.known.get(words, hashes)
        new = [k for k, x in enumerate(ids) if x is None]
        if new:
            own = [words[k] for k in new]
            made = self.merged(own, hashes[new])
            self.known.put(own, hashes[new], made)
            for k, x in zip(new, made, strict=True):
                ids[k] = x
        return cut_up.ids(ids)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec(path: str) -> Codec:
    """The worker process's codec for the file."""
    return held(f"codec of {path}", lambda: Codec(path))


def encoded(docs: DataFrame, path: str | None = None, texts_too: bool = False) -> DataFrame:
    """(doc_id, ids as little-endian unsigned 32-bit integers, n_tokens), and the decoded bytes
    with ``texts_too``, for every row of ``docs``."""
    path = path or vocab.default_path(VOCABULARY)
    made = "doc_id long, ids binary, n_tokens long" + ", decoded binary" * texts_too
    return _mapped(docs, path, made, lambda ids, bytes_: {"ids": ids, "n_tokens": len(ids) // 4} | ({"decoded": bytes_()} if texts_too else {}))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``."""
    from hashlib import sha256

    path = path or vocab.default_path(VOCABULARY)
    made = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, path, made, lambda ids, bytes_: {"n_tokens": len(ids) // 4, "ids_sha256": sha256(ids).hexdigest(), "decoded_sha256": sha256(bytes_()).hexdigest()})


def _mapped(docs: DataFrame, path: str, schema: str, row) -> DataFrame:
    """One row for each document: ``row`` gets its packed ids and a function that decodes them."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        own = codec(path)
        for batch in batches:
            names = batch.column("doc_id")
            for a, texts in byte_texts(batch.column("text"), CHUNK_BYTES):
                flat, size = own.encode([t.decode() for t in texts])
                packed, out, at = flat.astype("<u4").tobytes(), [], 0
                for name, n in zip(names.slice(a, len(texts)).to_pylist(), size.tolist(), strict=True):
                    one = row(packed[4 * at : 4 * (at + n)], lambda at=at, n=n: own.decode(flat[at : at + n].tolist()))
                    out.append({"doc_id": name} | one)
                    at += n
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)
