"""Token counts by rank-synchronous array merging.

The different pre-tokens of a batch are held as one ragged array of symbols. Each round finds,
for every sequence at once, the lowest rank among its neighbouring pairs, and merges all places
of that pair (from the left where they overlap). A sequence without a mergeable pair leaves the
array with the number of its surviving symbols. Counts of different pre-tokens are kept in a
bounded cache of the Python worker, and a text's count is the sum over its pre-tokens.

There is no shuffle and no state between tasks; memory is bounded by a chunk of texts.

Results: null text counts as empty (0 bytes, 0 tokens); texts of any length are counted whole;
every input row gives one row, repeated ids included; a null id stays null; an empty table
gives an empty table; extra columns of the input are not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.llm import pieces, vocab
from trendspark.llm.common import chunks

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
NONE = np.iinfo(np.int64).max


def merged_sizes(words: list[bytes], rules: vocab.Merges) -> np.ndarray:
    """Number of symbols that survive all merges, for each word."""
    out = np.zeros(len(words), np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    symbol = rules.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), size)
    while len(symbol):
        key = symbol[:-1] * rules.width + symbol[1:]
        at = np.minimum(np.searchsorted(rules.key, key), len(rules.key) - 1)
        known = (rules.key[at] == key) & (owner[:-1] == owner[1:])
        rank = np.append(np.where(known, rules.rank[at], NONE), NONE)
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        count = np.diff(np.append(begin, len(symbol)))
        lowest = np.minimum.reduceat(rank, begin)
        done = lowest == NONE
        out[owner[begin[done]]] = count[done]
        chosen = (rank == np.repeat(lowest, count)) & (rank != NONE)
        places = np.flatnonzero(chosen)
        if not len(places):
            break
        # a pair that overlaps the one before it (as in "aaa"): every second of such a chain
        head = np.append(True, np.diff(places) != 1)
        order = np.arange(len(places))
        order -= np.maximum.accumulate(np.where(head, order, 0))
        places = places[order % 2 == 0]
        symbol[places] = rules.made[rank[places]]
        left = ~np.repeat(done, count)
        left[places + 1] = False
        symbol, owner = symbol[left], owner[left]
    return out


def count_texts(texts: list[str], path: str, known: pieces.Bounded) -> np.ndarray:
    rules = vocab.merges(path)
    total = np.zeros(len(texts), np.int64)
    if rules.special:
        cut = re.compile("|".join(re.escape(s) for s, _ in sorted(rules.special, key=lambda x: -len(x[0]))))
        spans = [cut.split(t) for t in texts]
        total += np.fromiter((len(s) - 1 for s in spans), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in spans])
        texts = [x for s in spans for x in s]
    else:
        owner = np.arange(len(texts))
    cut_up = pieces.Pieces(texts)
    new = [w for w in cut_up.different if w not in known]
    known.room(len(new))
    if len(new) < len(cut_up.different) and not known:  # the cache was just emptied
        new = cut_up.different
    known.update(zip(new, merged_sizes([w.encode() for w in new], rules).tolist(), strict=True))
    each = np.fromiter((known[w] for w in cut_up.different), np.int64, len(cut_up.different))
    np.add.at(total, owner, cut_up.sums(each))
    return total


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text)."""
    path = path or vocab.default_path(VOCABULARY)

    def run(batches):
        import pyarrow as pa

        known = pieces.Bounded()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts, pieces.CHUNK_CHARS):
                part = texts[a:b]
                n = pa.array(count_texts(part, path, known), pa.int64())
                size = pa.array([len(t.encode()) for t in part], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), size, n], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
