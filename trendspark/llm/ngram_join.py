"""Near copies by an exact n-gram Jaccard join: a grouped prefix join.

Two texts link if their sets of distinct word n-grams have Jaccard similarity >= 3/4. In any
order of all n-grams, two such sets share one among the first |x| - ceil(3/4 |x|) + 1 of each
(the prefix). The steps, each a distributed job:

1. *Sets and sketch.* Each text gives its set's size and a 128-bit digest; texts with one digest
   are one node. In the same pass every n-gram of every text is counted in a sketch of fixed
   size (hashed counters). The sketch only decides the order: n-grams that seem frequent come
   last, by count, the others by hash. So passages that many texts share leave the prefixes.
2. *Groups.* Texts with the same prefix and size are one group, and send one posting for each
   n-gram of the prefix. Postings are shuffled and sorted by n-gram; groups that share an n-gram
   with no other group of a fitting size end here (the size filter of group pairs).
3. *Expand and verify.* The groups that are left expand to their nodes. In each n-gram's list
   the nodes are compared with one hub of about their size, by their whole sets; links give
   components. Then only pairs of nodes in different components are compared, in the last round
   all of them. So a group of m near copies costs about m comparisons and not m squared, and no
   link that joins two components is lost.
   Before whole sets travel, pairs are held against signatures, the numbers of hashes in equal
   ranges: two sets share at most the sum of the smaller numbers, so most pairs end there.
4. *Components* of the links (``links``): joined within tasks first, so no node has many.

Scale: nothing but the sketch (fixed size) reaches the driver, and nothing but bitmaps of at most
MOST_BITS bits is broadcast; lists are sorted streams that hold one row at a time, or joins and
windows of one group that spill. Tables are removed from the shared folder when the next one stands.
No candidate, bucket or group is capped.

Results: words are runs of characters other than blank and \\t-\\r, after lowering A-Z. A text of
fewer than n words is one n-gram; null or wordless texts have size 0 and link with nothing, so
their component is their own id. ``component_id`` is the smallest id of the component; null ids
count as documents, but name a component only if no other id does (null). Repeated ids: each row
is a text of its own; rows with the same set are always in one component. Empty tables give an
empty table; extra columns are not read. N-grams are told apart by 64-bit hashes, which matters
only within one comparison (a wrong result needs a collision within one pair of sets).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendspark.llm.common import byte_texts, discard, fresh, held, release, written
from trendspark.llm.links import components

N, NUMERATOR, DENOMINATOR = 5, 3, 4
CHUNK_BYTES, WINDOW = 1 << 20, 1 << 20
COUNTERS, BLOCK = 1 << 20, 1 << 13
BITS_A_KEY, MOST_BITS = 32, 1 << 28
LEAST_RANGES, MOST_RANGES = 4, 20
HUB_ROUNDS = 1
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


#: A 64-bit number for each byte at each place in a word (places repeat after PLACES, with another factor).
PLACES = 64
BYTE_AT = np.random.default_rng(20_417).integers(0, 1 << 64, PLACES * 256, np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of ``data`` (bytes), A-Z as a-z: the sum of its bytes' numbers.
    Reads WINDOW bytes at a time, so that a long text needs no more memory than its words' hashes."""
    hashes, starts, opened, within = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, False
    for a in range(0, len(data), WINDOW):
        part = LOWER[data[a : a + WINDOW]]
        word = IN_WORD[part]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        goes_on = bool(within and word[0])  # a word that the last window began
        begins[0] &= not goes_on
        at, within = np.flatnonzero(word), bool(word[-1])
        if not len(at):
            continue
        new = np.flatnonzero(begins) + a
        start = np.append(opened, new) if goes_on else new
        which = np.cumsum(begins[at]) - (not goes_on)
        place = at + a - start[which]
        value = BYTE_AT[(place % PLACES << 8) | part[at]]
        if int(place.max()) >= PLACES:
            value *= (2 * (place // PLACES) + 1).astype(np.uint64)
        sums = np.add.reduceat(value, np.flatnonzero(np.diff(which, prepend=-1)))
        if goes_on:
            hashes[-1][-1:] += sums[:1]
            sums = sums[1:]
        if len(sums):
            hashes.append(sums)
            starts.append(new)
        opened = start[-1]
    return np.concatenate(hashes), np.concatenate(starts)


def ngram_sets(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    flat, start = word_hashes(joined)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    size = np.diff(np.searchsorted(start, ends), prepend=0).tolist()
    flat ^= flat >> np.uint64(32)
    flat *= FACTORS[4]
    flat ^= flat >> np.uint64(29)
    factors = np.resize(FACTORS, n) + (np.arange(n, dtype=np.uint64) // np.uint64(len(FACTORS))) * np.uint64(2)
    total = np.zeros(max(0, len(flat) - n + 1), np.uint64)
    for i in range(n):
        total += flat[i : i + len(total)] * factors[i]
    total ^= total >> np.uint64(31)
    total *= FACTORS[1]
    total ^= total >> np.uint64(29)
    out, at = [], 0
    for k in size:
        if k >= n:
            out.append(np.unique(total[at : at + k - n + 1]))
        elif k:
            short = (flat[at : at + k] * factors[:k]).sum(keepdims=True)
            out.append(short * FACTORS[2] + np.uint64(k))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


class Marks:
    """The digests that lately came up, in a table of fixed size: one for each slot."""

    def __init__(self, bits: int = 17):
        self.slots = np.zeros((1 << bits, 2), np.uint64)

    def new(self, digest: bytes) -> bool:
        """Whether the digest (16 bytes) isn't in the table, where it is from now on."""
        low, high = np.frombuffer(digest, np.uint64)
        slot = self.slots[int(low) % len(self.slots)]
        if slot[0] == low and slot[1] == high:
            return False
        slot[0], slot[1] = low, high
        return True


def prefix_length(n: int) -> int:
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1


def levels(counts: np.ndarray) -> np.ndarray:
    """For each counter 0, or how far it stands out of the mean, as a power of two."""
    mean = counts.sum() / len(counts)
    more = counts - mean - 6 * math.sqrt(mean)
    return np.where(more > 16, np.log2(np.maximum(more, 1)), 0).astype(np.uint8)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _each(batches, columns: list[str], n: int):
    """(values of ``columns``, set) of each text."""
    held("word n-grams")
    for batch in batches:
        own = [batch.column(c) for c in columns]
        for a, texts in byte_texts(batch.column("text"), CHUNK_BYTES):
            yield [c.slice(a, len(texts)).to_pylist() for c in own], ngram_sets(texts, n)
    release()


def _sets_and_sketch(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_key, size, node) for each row, and (block, counts) of each task's sketch."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        kinds = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("size", pa.int32()), ("node", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])
        sketch = np.zeros(COUNTERS, np.int32)
        for (ids, keys), sets in _each(batches, ["doc_id", "text_key"], n):
            size = [len(s) for s in sets]
            sketch += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=COUNTERS).astype(np.int32)
            nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            none = [None] * len(ids)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "text_key": keys, "size": size, "node": nodes, "block": none, "counts": none}, schema=kinds)
        blocks = [(k, part.tobytes()) for k, part in enumerate(sketch.reshape(-1, BLOCK)) if part.any()]
        none = [None] * len(blocks)
        yield pa.RecordBatch.from_pydict({"doc_id": none, "text_key": none, "size": none, "node": none, "block": [k for k, _ in blocks], "counts": [c for _, c in blocks]}, schema=kinds)

    return _texts(docs).mapInArrow(run, "doc_id long, text_key long, size int, node binary, block int, counts binary")


def _order(passed: DataFrame) -> np.ndarray:
    """The level of each counter of the summed sketch."""

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"block": list(sums), "counts": [c.tobytes() for c in sums.values()]}, schema=pa.schema([("block", pa.int32()), ("counts", pa.binary())]))

    total = np.zeros(COUNTERS, np.int64)
    blocks = passed.where("block is not null").select("block", "counts").repartition("block")
    for r in blocks.mapInArrow(add, "block int, counts binary").collect():  # COUNTERS numbers at most
        total[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.int64)
    return levels(total)


def _postings(docs: DataFrame, level: np.ndarray, n: int) -> DataFrame:
    """(token, grp, size) for each n-gram of a group's prefix, once for each task, and
    (token = group, node, -size, end) for each node of a group; end: the place in the order of
    all n-grams where its prefix ends."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        import pyarrow as pa
        import xxhash

        level = shared.value
        nodes_seen, groups_seen = Marks(), Marks()
        for _, sets in _each(batches, [], n):
            tokens, groups, sizes, members = [], [], [], []
            for s in sets:
                if not len(s):
                    continue
                node = xxhash.xxh3_128_digest(s.tobytes())
                if not nodes_seen.new(node):
                    continue
                p = prefix_length(len(s))
                place = (level[s >> np.uint64(44)].astype(np.int64) << 56) | (s >> np.uint64(8)).astype(np.int64)
                chosen = np.argsort(place, kind="stable")[:p]
                first = s[chosen]
                digest = xxhash.xxh3_128_digest(first.tobytes() + len(s).to_bytes(8, "little"))
                group = int.from_bytes(digest[:8], "little", signed=True)
                members.append((group, node, -len(s), int(place[chosen[-1]])))
                if groups_seen.new(digest):
                    tokens.append(first)
                    groups.append(np.full(p, group, np.int64))
                    sizes.append(np.full(p, len(s), np.int32))
            m = len(members)
            if m:
                flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([flat, np.array([x[0] for x in members], np.int64)])),
                        pa.concat_arrays([pa.array(np.concatenate(groups) if groups else np.zeros(0, np.int64)), pa.nulls(m, pa.int64())]),
                        pa.concat_arrays([pa.nulls(len(flat), pa.binary()), pa.array([x[1] for x in members], pa.binary())]),
                        pa.array(np.concatenate([*sizes, np.array([x[2] for x in members], np.int32)])),
                        pa.concat_arrays([pa.nulls(len(flat), pa.int64()), pa.array([x[3] for x in members], pa.int64())]),
                    ],
                    names=["token", "grp", "node", "size", "end"],
                )

    return _texts(docs).select("text").mapInArrow(run, "token long, grp long, node binary, size int, end long")


def _fitting(sorted_postings: DataFrame) -> DataFrame:
    """Of rows sorted by token and size: the members, and the postings next to another group of
    their token with a fitting size. Holds one batch and one row."""

    def run(batches):
        import pyarrow as pa

        held = None

        def chosen(t: pa.Table, last: bool):
            """What to pass on of ``t``, and its last row, of which the next one may decide."""
            token, size = t.column("token").to_numpy(), t.column("size").to_numpy().astype(np.int64)
            group = t.column("grp").fill_null(0).to_numpy()
            same = (token[1:] == token[:-1]) & (size[1:] > 0) & (size[:-1] > 0)
            twice = same & (group[1:] == group[:-1]) & (size[1:] == size[:-1])
            fits = same & ~twice & (size[:-1] * DENOMINATOR >= size[1:] * NUMERATOR)
            own = size < 0
            own[1:] |= fits
            own[:-1] |= fits
            own |= t.column("fits").to_numpy(zero_copy_only=False)
            again = np.append(False, twice)
            if again.any():  # a repeated posting hands its finding on to the one after it
                for i in np.flatnonzero(again).tolist():
                    own[i] |= own[i - 1] and size[i] > 0
                own[np.flatnonzero(again) - 1] = False
            if last:
                return t.filter(pa.array(own)).drop_columns(["fits"]), None
            kept = own.copy()
            kept[-1] = False
            tail = t.slice(len(t) - 1).drop_columns(["fits"]).append_column("fits", pa.array([bool(own[-1])]))
            return t.filter(pa.array(kept)).drop_columns(["fits"]), tail

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t.append_column("fits", pa.array(np.zeros(len(t), bool)))
            if held is not None:
                t = pa.concat_tables([held, t]).combine_chunks()
            if len(t):
                out, held = chosen(t, False)
                yield from out.to_batches()
        if held is not None:
            yield from chosen(held, True)[0].to_batches()

    return sorted_postings.mapInArrow(run, "token long, grp long, node binary, size int, end long")


def marked(keys: DataFrame, most_bits: int = MOST_BITS):
    """A filter for rows whose ``key`` (long) may be among ``keys`` (key): a bitmap of BITS_A_KEY bits
    for each key, but ``most_bits`` at most, is broadcast in rows of 64 bits. The second value tells
    whether the bitmap has its full size."""
    n = keys.count()
    bits = 64
    while bits < min(BITS_A_KEY * n, most_bits):
        bits *= 2
    word = F.shiftrightunsigned(F.pmod(F.col("key"), F.lit(bits)), 6).alias("word")
    bit = F.expr(f"shiftleft(1L, cast(pmod(key, {bits}L) & 63 as int))")
    bitmap = keys.groupBy(word).agg(F.bit_or(bit).alias("bits"))
    return lambda df: df.withColumn("word", word).join(F.broadcast(bitmap), "word").where(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits"), bits >= BITS_A_KEY * n


def signature(s: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall into each of about half as many equal ranges."""
    buckets = 1 << min(MOST_RANGES, max(LEAST_RANGES, (len(s) - 1).bit_length() - 1))
    return np.bincount((s >> np.uint64(65 - buckets.bit_length())).astype(np.int64), minlength=buckets).astype(np.uint16 if len(s) < 1 << 16 else np.uint32)


def most_shared(x: np.ndarray, y: np.ndarray) -> int:
    """What two sets can share at most, by their signatures: never less than what they do."""
    if len(x) < len(y):
        x, y = y, x
    return int(np.minimum(x.reshape(len(y), -1).sum(axis=1), y).sum())


def _whole_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, size, tokens, ranges) for each of ``nodes``, from the text of one row of each; other
    nodes and, where rows are repeated, equal lines may be among them."""
    first = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("row"))
    key = F.xxhash64("doc_id", "text_key").alias("key")
    wanted = written(first.select("row.*").select("doc_id", "text_key", key).distinct(), "wanted-texts")
    may_be, full = marked(wanted.select("key"))
    texts = may_be(_texts(docs).withColumn("key", key))
    if not full:  # too many for the bitmap to tell
        texts = texts.join(wanted.select("key"), "key", "left_semi")

    def run(batches):
        import pyarrow as pa
        import xxhash

        for _, sets in _each(batches, [], n):
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([signature(s).tobytes() for s in sets], pa.binary()),
                ],
                names=["node", "size", "tokens", "ranges"],
            )

    sets = written(texts.select("text").mapInArrow(run, "node binary, size int, tokens array<long>, ranges binary"), "whole-sets")
    discard(wanted)
    return sets


def _plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose signatures allow a link: these travel instead of whole sets."""
    one = sets.groupBy("node").agg(F.first(F.struct("size", "ranges")).alias("of"))
    x, y = (one.select(F.col("node").alias(k), F.col("of").alias(f"of_{k}")) for k in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", F.col("of_a.size").alias("m"), F.col("of_a.ranges").alias("x"), F.col("of_b.size").alias("n"), F.col("of_b.ranges").alias("y"))

    def run(batches):
        import pyarrow as pa

        kind = lambda n: np.uint16 if n < 1 << 16 else np.uint32
        for batch in batches:
            m, x, n, y = (batch.column(c).to_pylist() for c in ("m", "x", "n", "y"))
            keep = [(NUMERATOR + DENOMINATOR) * most_shared(np.frombuffer(p, kind(i)), np.frombuffer(q, kind(j))) >= NUMERATOR * (i + j) for i, p, j, q in zip(m, x, n, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(both.mapInArrow(run, "a binary, b binary"), "plausible-pairs")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that link, by their whole sets."""
    plausible = _plausible(pairs, sets)
    key = F.xxhash64("node").alias("key")
    nodes = plausible.select(F.col("a").alias("node")).union(plausible.select("b")).distinct()
    may_be, _ = marked(nodes.select(key))
    own = may_be(sets.select("node", "tokens", key)).groupBy("node").agg(F.first("tokens").alias("tokens"))
    x, y = own.select(F.col("node").alias("a"), F.col("tokens").alias("x")), own.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    found = written(plausible.join(x, "a").join(y, "b").where(shared * DENOMINATOR >= union * NUMERATOR).select("a", "b"), "linked-pairs")
    discard(plausible)
    return found


def linked_rows(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, text_key, size, component_id, component) for every row of ``docs``."""
    passed = written(_sets_and_sketch(docs, n), "sets")
    rows = passed.where("size is not null").select("doc_id", "text_key", "size", "node")
    postings = _postings(docs, _order(passed), n)
    by_token = postings.repartition("token").sortWithinPartitions("token", "size", "grp", "node")
    kept = written(_fitting(by_token), "group-postings")
    members = kept.where("size < 0").select(F.col("token").alias("grp"), "node", (-F.col("size")).alias("size"), "end").distinct()
    postings_left = kept.where("size > 0").select("token", "grp")
    after_prefix = F.expr(f"(size * {NUMERATOR} + {DENOMINATOR - 1}) div {DENOMINATOR} - 1")
    # If a list's n-gram is the first that two nodes share, in the order of the lists' lengths, a node shares with one whose
    # prefix ends later at most its own listed n-grams from this one on, and what follows its prefix. So each list but the
    # first of a pair has a smaller bound, and long lists, which come last, lose most of their rows.
    length = postings_left.groupBy("token").agg(F.count(F.lit(1)).alias("length"))
    of_group = Window.partitionBy("grp")
    backwards = of_group.orderBy(F.desc("length"), F.desc("token"))
    from_here, before = F.row_number().over(backwards).alias("from_here"), F.lead("token").over(backwards).alias("before")
    placed = postings_left.join(length, "token").select("token", "grp", from_here, before, F.count(F.lit(1)).over(of_group).alias("shared"))
    most, central = (after_prefix + F.col("from_here")).alias("most"), F.floor(100 * (after_prefix + F.col("shared")) / F.col("size")).alias("central")
    of_groups = placed.join(members, "grp").select("token", "node", "size", "end", most, central, "before")
    many = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp")
    within = members.join(many, "grp").select(F.col("grp").alias("token"), "node", "size", "end", F.col("size").cast("long").alias("most"), F.lit(100).cast("long").alias("central"), F.lit(None).cast("long").alias("before"))
    lists = written(_with_a_partner(of_groups.union(within)), "node-lists")
    discard(kept)
    full = rows.where("node is not null")

    spark = docs.sparkSession
    edges = spark.createDataFrame([], "a binary, b binary")
    labels = tried = None
    for salt in (*range(HUB_ROUNDS), None):
        named = lists.withColumn("label", F.col("node")) if labels is None else lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        pairs = (_crossing(named) if salt is None else _with_hub(named, salt)).distinct()
        new = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if new.isEmpty():
            continue
        nodes = new.select(F.col("a").alias("node")).union(new.select("b")).distinct()
        sets = _whole_sets(docs, full, nodes, n)
        found = _linked(new, sets)
        discard(sets)
        tried = new if tried is None else tried.union(new)
        if found.isEmpty():
            continue
        edges = edges.union(found)
        labels = components(edges)
    discard(lists)
    return _named(rows, labels if labels is not None else spark.createDataFrame([], "node binary, label binary"))


def _may_link(x: str, y: str):
    """Whether the sizes, and what a node can share at most, allow a link."""
    least = f"{NUMERATOR} * ({x}.size + {y}.size)"
    after = lambda p: f"(({p}.size * {NUMERATOR} + {DENOMINATOR - 1}) div {DENOMINATOR})"
    reach = lambda p, q: f"({p}.end <= {q}.end and {NUMERATOR + DENOMINATOR} * least({p}.most, {q}.most + {after(p)} - {after(q)}) >= {least})"
    return F.expr(f"least({x}.size, {y}.size) * {DENOMINATOR} >= greatest({x}.size, {y}.size) * {NUMERATOR} and ({reach(x, y)} or {reach(y, x)})")


def _with_a_partner(lists: DataFrame) -> DataFrame:
    """The rows of each token's list that can link with another row of it at all: by ``_may_link``,
    one of the two must reach the size of the other, so rows stay that reach the list's smallest
    size, or that the list's widest reach covers."""
    reach = F.expr(f"({NUMERATOR + DENOMINATOR} * most) div {NUMERATOR} - size")
    of_token = lists.withColumn("reach", reach).groupBy("token").agg(F.min("size").alias("smallest"), F.max("reach").alias("widest"), F.count(F.lit(1)).alias("n"))
    of_token = of_token.where("n > 1 and widest >= smallest").select("token", "smallest", "widest")
    return lists.join(of_token, "token").where((reach >= F.col("smallest")) | (F.col("size") <= F.col("widest"))).select(*lists.columns)


def _with_hub(lists: DataFrame, salt: int) -> DataFrame:
    """Each node with the hub of its token and size class: first the node that shares the largest
    part of its n-grams with others (the text that near copies come from, not one of its changed
    copies; ties by a hash, the same node wherever it stands), later another one for each token."""
    ratio = math.log(DENOMINATOR / NUMERATOR)
    size_class = F.floor(F.log(F.col("size")) / F.lit(ratio))
    key = F.struct(-F.col("central"), F.xxhash64("node")) if salt == 0 else F.xxhash64("node", "token", F.lit(salt))
    own = F.struct("node", "size", "label", "end", "most")
    placed = lists.withColumn("class", size_class)
    of_class = placed.groupBy("token", "class").agg(F.min(F.struct(key, own.alias("x")))["x"].alias("hub"), F.min("label").alias("p"), F.max("label").alias("q"))
    hubs = of_class.groupBy("token").agg(F.min("p").alias("p"), F.max("q").alias("q"), F.collect_list(F.struct("class", "hub")).alias("hubs")).where("p <> q")  # a few classes
    hub = F.filter("hubs", lambda h: h["class"] == F.col("class"))[0]["hub"].alias("y")
    paired = placed.join(hubs.select("token", "hubs"), "token").select(own.alias("x"), hub).where("x.node <> y.node and x.label <> y.label").where(_may_link("x", "y"))
    return paired.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _crossing(lists: DataFrame) -> DataFrame:
    """All pairs of nodes of one token, in different components, that may link, and for which it
    may be the first shared one: where both have the same n-gram before it, an earlier list has the pair."""
    mixed = lists.groupBy("token").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p <> q").select("token")
    left = lists.join(mixed, "token")
    x, y = left.alias("x"), left.alias("y")
    both = x.join(y, F.expr("x.token = y.token and x.node < y.node and x.label <> y.label and not coalesce(x.before = y.before, false)") & _may_link("x", "y"))
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    full, empty = rows.where("node is not null"), rows.where("node is null")
    least = full.groupBy("node").agg(F.min("doc_id").alias("least"))
    group = least.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("component"))
    of_group = group.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = group.select("node", "component").join(of_group, "component")
    named = full.join(of_node, "node").select("doc_id", "text_key", "size", "component_id", "component")
    return named.union(empty.select("doc_id", "text_key", "size", "doc_id", F.lit(None).cast("binary")))


def near_copies(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    return linked_rows(docs, n).select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (then by a hash of
    its text; a row that repeats another's id and text is dropped). Wordless rows all stay."""
    named = written(linked_rows(docs, n), "linked-rows")
    first = named.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("row"))
    key, stay_id, stay_key = fresh(docs, "near_key", "stay_id", "stay_key")
    stay = first.select(F.col("row.doc_id").alias(stay_id), F.col("row.text_key").alias(stay_key))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn(key, F.xxhash64(text))
    wordless = F.length(F.translate(text, " \t\n\x0b\f\r", "")) == 0
    kept = keyed.where(~wordless).join(stay, (F.col(key) == F.col(stay_key)) & F.col("doc_id").eqNullSafe(F.col(stay_id)), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).union(keyed.where(wordless)).drop(key)
