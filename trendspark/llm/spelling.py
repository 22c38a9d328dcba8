"""Spelling variants: words one edit apart, each with its commoner form, by dense prefix-suffix tiling.

1. *Words.* Runs of letters of whole texts are counted, once for each text, then over all texts
   (each task sends sums). The production query deletes a code point of some runs first (``typo``).
2. *Tiles.* Two words one insertion, deletion or replacement apart, the shorter of length L, have their
   first L//2 or their last L//2 code points in common. So each word joins the strips (side, L, half)
   of its own length L, and of L - 1 as the longer word. Strips of more than BLOCK words are cut into
   blocks by a hash, and each pair of blocks (a block with itself included) is a tile: as many small
   tasks as it takes, whatever the strip's size. Every pair of words that can be near meets in a tile.
3. *Dense comparison.* A tile's words are rows of padded code-point matrices, once flush left, once
   flush right. Comparing a matrix with itself column by column gives the length of the common prefix
   and suffix of all pairs; a pair is near if prefix + suffix >= longer length - 1. Pairs that share
   the first half count in the strip of first halves only. Consecutive small strips fill one matrix,
   masked by strip, so that numpy always works on whole blocks.
4. *Forms.* Each tile sends for each word its number of near words and the commonest, with its count;
   these meet by word. Roots follow forms by pointer doubling; n at least doubles with each form, so
   chains are short.

Scale: a word is sent about four times, more only in strips of more than BLOCK words. A task holds one
tile (at most two blocks) and one Arrow batch; a matrix comparison holds at most CELLS pairs.

Results: null and empty texts have no words. A null id is written as the empty string before the
colon. Repeated rows count again. Ties between near words of equal n go to the smaller in code-point order.
Very long texts are read whole; very long words make narrower matrices. A word that deletion leaves
shorter than the least length is none. Empty tables give an empty table; extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import byte_texts, written

RUN = "[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO, ONE_IN = 5, 3, 2, 97
CHUNK_BYTES, HELD_WORDS = 1_500_000, 150_000
BLOCK, CELLS, CODES = 1 << 10, 1 << 22, 1 << 22
ROWS, WIDE = 384, 64


def typo(doc_id: int | None, word: str, one_in: int = ONE_IN) -> str:
    """``word`` as document ``doc_id`` spells it: one of ``one_in`` lacks a code point."""
    return _typo(zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), word, one_in)


def _typo(start: int, word: str, one_in: int) -> str:
    h = zlib.crc32(word.encode(), start)
    if h % one_in:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def words(docs: DataFrame, one_in: int | None = ONE_IN, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) over all texts of ``docs`` (doc_id, text); ``one_in`` None: no deletions."""

    def run(batches):
        import re
        from collections import Counter

        import pyarrow as pa

        find, held = re.compile(RUN).findall, Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, texts in byte_texts(batch.column("text"), CHUNK_BYTES):
                for i, text in zip(ids[a : a + len(texts)], texts, strict=True):
                    own = Counter(find(text.lower().decode()))  # bytes: lower() changes A-Z only
                    if one_in is None:
                        held.update({w: n for w, n in own.items() if len(w) >= length})
                        continue
                    start = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for w, n in own.items():
                        if len(w) >= length:
                            w = _typo(start, w, one_in)
                            if len(w) >= length:
                                held[w] += n
                    if len(held) > HELD_WORDS:
                        yield out()
                        held = Counter()
        yield out()

    found = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def _strips(found: DataFrame) -> DataFrame:
    """(side, short, half, longer, word, n): each word in the strips it belongs to."""
    size = F.length("word")

    def strip(side: str, longer: bool):
        short = size - 1 if longer else size
        m = F.floor(short / 2).cast("int")
        half = F.substring("word", F.lit(1), m) if side == "first" else F.substring("word", size - m + 1, m)
        return F.struct(F.lit(side == "first").alias("first"), short.alias("short"), half.alias("half"), F.lit(longer).alias("longer"))

    each = F.array(*(strip(side, longer) for side in ("first", "last") for longer in (False, True)))
    return found.select("word", "n", F.explode(each).alias("s")).select("s.*", "word", "n")


def _tiles(found: DataFrame) -> DataFrame:
    """(tile, i, j, first, short, half, block, longer, word, n): the rows of each tile i, j of a strip."""
    strips, key = _strips(found), ["first", "short", "half"]
    most = F.greatest(F.least(F.lit(BLOCK), F.floor(F.lit(CODES) / (F.col("short") + 1))), F.lit(2))
    large = strips.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most).withColumn("blocks", F.ceil(F.col("size") / most).cast("int"))
    cut = strips.join(large.select(*key, "blocks"), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("word", F.lit("block")), F.col("blocks")).cast("int")
    placed = cut.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    return placed.select(*key, i, j, "block", "longer", "word", "n")


class Tile:
    """Rows of one or more tiles, sorted by tile; ``near`` compares them densely."""

    def __init__(self, words: list[str], group: np.ndarray, block: np.ndarray, two: np.ndarray, longer: np.ndarray, first: np.ndarray):
        self.size = np.fromiter(map(len, words), np.int32, len(words))
        self.group, self.block, self.two, self.longer, self.first = group, block, two, longer, first
        width = int(self.size.max())
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(flat) or flat.max() < 256:
            flat = flat.astype(np.uint8)
        row = np.repeat(np.arange(len(words)), self.size)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.left = np.zeros((width, len(words)), flat.dtype)
        self.right = np.zeros((width, len(words)), flat.dtype)
        self.left[column, row] = flat
        self.right[np.repeat(self.size, self.size) - 1 - column, row] = flat

    @staticmethod
    def _common(matrix: np.ndarray, a: slice, b: slice) -> np.ndarray:
        """Length of the common start of all pairs of rows; the padding ends it, as words differ."""
        same = np.ones((a.stop - a.start, b.stop - b.start), bool)
        total = np.zeros(same.shape, np.int32 if len(matrix) > 250 else np.uint8)
        for line in matrix:
            same &= line[a, None] == line[None, b]
            if not same.any():
                break
            total += same
        return total

    def near(self):
        """(x, y) of near pairs, x < y, each once for each tile that it may count in."""
        n = len(self.size)
        step = max(1, min(n, CELLS // n))
        for i in range(0, n, step):
            a, b = slice(i, min(i + step, n)), slice(i, n)
            reach = self._common(self.left, a, b)
            longest = np.maximum(self.size[a, None], self.size[None, b])
            both = np.minimum(reach.astype(np.int32) + self._common(self.right, a, b), longest)
            x, y = np.nonzero((both >= longest - 1) & (self.group[a, None] == self.group[None, b]))
            half = reach[x, y]
            x, y = x + i, y + i
            fits = (x < y) & ~(self.longer[x] & self.longer[y])
            fits &= ~self.two[x] | (self.block[x] != self.block[y])
            fits &= self.first[x] | (half < np.minimum(self.size[x], self.size[y]) // 2)
            yield x[fits], y[fits]


def _parts(words, n, tile: Tile):
    """(word, near words, n of the commonest, the commonest) of each word with near words in ``tile``."""
    pairs = [np.column_stack(p) for p in tile.near()]
    if not pairs or not sum(map(len, pairs)):
        return [], [], [], []
    pairs = np.concatenate(pairs)
    best: dict[int, list] = {}
    for x, y in np.concatenate([pairs, pairs[:, ::-1]]).tolist():
        mine, other = best.get(x), (-n[y], words[y])
        if mine is None:
            best[x] = [1, other]
        else:
            mine[0] += 1
            mine[1] = min(mine[1], other)
    return [words[x] for x in best], [c for c, _ in best.values()], [-o[0] for _, o in best.values()], [o[1] for _, o in best.values()]


def near_words(found: DataFrame) -> DataFrame:
    """(word, n_near, most_n, most_word) for each word of ``found`` (word, n) with a near word."""

    def run(batches):
        import pyarrow as pa

        held, group, last = None, 0, None

        def compared(t: pa.Table, numbers: np.ndarray):
            words, n = t.column("word").to_pylist(), t.column("n").to_pylist()
            column = lambda name: t.column(name).to_numpy(zero_copy_only=False)
            tile = Tile(words, numbers, column("block"), column("i") != column("j"), column("longer"), column("first"))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(_parts(words, n, tile), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "most_n", "most_word"])

        def cuts(numbers: np.ndarray, short: np.ndarray, ended: bool):
            """Where whole tiles end, about ROWS rows apart; the last tile stays unless ``ended``.
            Tiles of words of over WIDE code points stand alone."""
            ends = np.flatnonzero(numbers[1:] != numbers[:-1]) + 1
            ends = np.append(ends, len(numbers)) if ended else ends
            at = 0
            while at < len(numbers):
                k = int(np.searchsorted(ends, at + ROWS, "right")) - 1
                if k < 0 or ends[k] <= at or short[ends[k] - 1] > WIDE:
                    k = int(np.searchsorted(ends, at, "right"))
                if k >= len(ends):
                    return
                yield at, int(ends[k])
                at = int(ends[k])

        def numbered(t: pa.Table) -> np.ndarray:
            """A number for each row's tile; rows of one tile stand together."""
            turn = np.zeros(len(t), bool)
            for name in ("first", "short", "half", "i", "j"):
                c = t.column(name).combine_chunks()
                turn[1:] |= np.asarray(c.slice(1).to_numpy(zero_copy_only=False) != c.slice(0, len(c) - 1).to_numpy(zero_copy_only=False), bool)
            return np.cumsum(turn)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if len(held) < 8 * ROWS:
                continue
            numbers, at = numbered(held), 0
            for a, b in cuts(numbers, held.column("short").to_numpy(), False):
                yield compared(held.slice(a, b - a), numbers[a:b])
                at = b
            held = held.slice(at).combine_chunks()
        if held is not None and len(held):
            numbers = numbered(held)
            for a, b in cuts(numbers, held.column("short").to_numpy(), True):
                yield compared(held.slice(a, b - a), numbers[a:b])

    key = ["first", "short", "half", "i", "j"]
    # a fixed number of tasks: tiles are few bytes and much work, so partitions joined by their bytes would be long tasks
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _tiles(found).repartition(tasks, *key).sortWithinPartitions(*key, "word")
    parts = dealt.mapInArrow(run, "word string, n_near long, most_n long, most_word string")
    most = F.min(F.struct((-F.col("most_n")).alias("n"), F.col("most_word").alias("word"))).alias("most")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), most).select("word", "n_near", (-F.col("most.n")).alias("most_n"), F.col("most.word").alias("most_word"))


def _roots(linked: DataFrame) -> DataFrame:
    """(word, root) for each word of ``linked`` (word, form), by pointer doubling."""
    now = linked.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def grouped(found: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``found`` (word, n), distinct words."""
    near = found.join(near_words(found), "word", "left")
    whole = F.col("most_n") >= ratio * F.col("n")
    formed = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(whole, F.col("most_word")).alias("form"), F.when(whole, F.col("most_n")).alias("form_n")), "forms")
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, one_in: int | None = ONE_IN, length: int = LEAST_LENGTH, count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of ``docs`` (doc_id, text)."""
    return grouped(written(words(docs, one_in, length, count), "words"), ratio)
