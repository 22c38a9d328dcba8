"""Near copies by SimHash: fingerprints of 64 bits that differ in at most 3 are linked, exactly.

1. *Fingerprints.* Each text's word n-grams are hashed by XXH64 (seed 42); a bit of the fingerprint is
   1 if over half of the n-grams have it. Equal fingerprints become one point.
2. *Shards.* A vantage-point tree is fitted on a sample of the points (about SAMPLE for each shard,
   a bound that only balances the shards) and sent to all tasks. Each inner node has a vantage point
   and a radius, the median of the sample's Hamming distances from it. Every point goes down to one
   leaf, its shard. Where a point lies outside a radius, but by the triangle inequality could have a
   partner within it, it visits the shards inside as a guest, down every branch that the bounds leave
   open. So of each linked pair one point meets the other in its home shard.
3. *Search.* Each shard builds a vantage-point tree over its own points and sends guests, batch by
   batch, down the same bounds; only points of open leaves are compared, all exactly. Links found are
   joined at once (union-find), so a dense group leaves one link for each point and not all pairs.
4. *Components* of these links over all shards (``links``), then least ids.

Scale: points are 8 bytes each. There are at least 4 shards a core and SHARD points in each of
them beyond that, up to MOST_SHARDS, so the tree that the driver fits and broadcasts is bounded. Shards
are dealt one a partition. A task holds a shard's own points and one batch of guests. A group of exact
copies is one point; a group of near copies is cut into as many shards as its share of the sample.
The number of visits grows about as the power 0.6 of the number of points for hashes of unrelated
texts (distances lie near 32), which is the price of an exact answer from such trees.

Results: words are runs of characters other than blank and \\t-\\r, after lowering A-Z. Fewer than n
words: the whole sequence is the one n-gram. Null and wordless texts have the fingerprint zero, linked
like any other. Repeated rows and ids: each row is a text of its own; ``component_id`` is the
smallest id of the component (null if it has none). Very long texts are hashed whole, in pieces.
Empty tables give an empty table; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import byte_texts, written
from trendspark.llm.links import Groups, components

N, SEED, MOST_BITS = 3, 42, 3
CHUNK_BYTES, CHUNK_HASHES = 1_500_000, 1 << 18
SAMPLE, SHARD, MOST_SHARDS = 64, 1 << 16, 1 << 12
LEAF, TRIED = 48, 6


def fingerprint(words: list[bytes], n: int = N) -> int:
    """The fingerprint of one text's words."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(n)), strict=False) if len(words) >= n else [words]
    set_bits, count, held = np.zeros(64, np.int64), 0, []
    for gram in grams:
        held.append(xxh64_intdigest(b" ".join(gram), SEED))
        if len(held) == CHUNK_HASHES:
            set_bits, count, held = set_bits + _bits(held), count + len(held), []
    if held:
        set_bits, count = set_bits + _bits(held), count + len(held)
    return int(np.packbits(2 * set_bits > count).view(">u8")[0])


def _bits(hashes: list[int]) -> np.ndarray:
    """How many of ``hashes`` have each bit, the highest first."""
    return np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, point) for each row of ``docs`` (doc_id, text); point: the fingerprint as a signed long."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = [fingerprint(t.lower().split(), n) for _, texts in byte_texts(batch.column("text"), CHUNK_BYTES) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(own, np.uint64).view(np.int64))], names=["doc_id", "point"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, point long")


class VantageTree:
    """A vantage-point tree over 64-bit points (uint64); ``leaves`` or ``size`` end the splitting.

    Nodes are numbered from 0: ``vantage``, ``radius``, ``inside`` and ``outside`` (the number of
    the child, or -1 - leaf).
    """

    def __init__(self, points: np.ndarray, size: int = LEAF, leaves: int | None = None):
        self.vantage, self.radius, self.inside, self.outside = [], [], [], []
        self.n_leaves = 0
        self.root = self._grow(points, size, leaves)

    def _leaf(self) -> int:
        self.n_leaves += 1
        return -self.n_leaves

    def _grow(self, points: np.ndarray, size: int, leaves: int | None) -> int:
        if len(points) <= 1 or (len(points) <= size if leaves is None else leaves <= 1):
            return self._leaf()
        chosen = self._vantage(points)
        if chosen is None:
            return self._leaf()
        vantage, radius, within = chosen
        node = len(self.vantage)
        for column, value in ((self.vantage, vantage), (self.radius, radius), (self.inside, 0), (self.outside, 0)):
            column.append(value)
        share = None if leaves is None else min(max(1, round(leaves * float(within.mean()))), leaves - 1)
        self.inside[node] = self._grow(points[within], size, share)
        self.outside[node] = self._grow(points[~within], size, None if leaves is None else leaves - share)
        return node

    @staticmethod
    def _vantage(points: np.ndarray):
        """Of a few candidates the one whose distances spread most around their median."""
        best = None
        for vantage in points[:: max(1, len(points) // TRIED)][:TRIED]:
            far = np.bitwise_count(points ^ vantage).astype(np.int16)
            # a radius that leaves points on both sides, as near to the median as can be
            counts = np.cumsum(np.bincount(far, minlength=65))
            radius = int(np.argmin(np.abs(2 * counts - len(far))))
            if 0 < counts[radius] < len(far):
                spread = float(np.abs(far - radius - 0.5).sum())
                if best is None or spread > best[0]:
                    best = spread, vantage, radius, far <= radius
        return best and best[1:]

    def walk(self, own: np.ndarray, guests: np.ndarray, reach: int = MOST_BITS):
        """(leaf, indices of own points at home there, indices of own points and, from len(own)
        on, guests that visit it): every pair of an own point with a point at most ``reach`` bits
        away meets in the leaf of one of both."""
        points = np.concatenate([own, guests])
        stack = [(self.root, np.arange(len(own)), np.arange(len(own), len(points)))]
        while stack:
            node, home, visit = stack.pop()
            if not len(home) and not len(visit):
                continue
            if node < 0:
                yield -1 - node, home, visit
                continue
            vantage, radius = self.vantage[node], self.radius[node]
            home_far = np.bitwise_count(points[home] ^ vantage).astype(np.int16)
            visit_far = np.bitwise_count(points[visit] ^ vantage).astype(np.int16)
            within = home_far <= radius
            near = home[~within & (home_far - reach <= radius)]
            stack.append((self.outside[node], home[~within], visit[visit_far + reach > radius]))
            stack.append((self.inside[node], home[within], np.concatenate([visit[visit_far - reach <= radius], near])))


class Shard:
    """The points at home in one shard, searched by guests; keeps links as groups of points."""

    def __init__(self, points: np.ndarray, reach: int = MOST_BITS):
        self.points, self.reach, self.groups = points, reach, Groups()
        self.tree = VantageTree(points)
        self.label = np.arange(len(points))
        self.homes: dict[int, np.ndarray] = {}
        met = list(self.tree.walk(points, points[:0], reach))
        for leaf, home, _ in met:
            self.homes[leaf] = home
        for leaf, home, visit in met:
            self._link(home, home, points)
            self._link(visit, home, points)

    def _near(self, a: np.ndarray, b: np.ndarray, step: int = 1 << 16):
        for i in range(0, len(a), step):
            x, y = np.nonzero(np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= self.reach)
            yield x + i, y

    def _link(self, one: np.ndarray, home: np.ndarray, points: np.ndarray) -> None:
        """Join own points, given by indices, that are near each other."""
        for x, y in self._near(points[one], points[home]):
            a, b = self.label[one[x]], self.label[home[y]]
            apart = np.unique(np.column_stack([a, b])[a != b], axis=0)
            for p, q in apart.tolist():
                self.groups.join(p, q)
            if len(apart):
                touched = np.unique(apart)
                now = {k: self.groups.root(k) for k in touched.tolist()}
                # labels of whole groups: only those of points whose label was joined change
                order = np.array(sorted(now), np.int64)
                target = np.array([now[k] for k in order.tolist()], np.int64)
                at = np.searchsorted(order, self.label)
                at[at == len(order)] = 0
                hit = order[at] == self.label
                self.label[hit] = target[at[hit]]

    def visited(self, guests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links (guest, point at home): one for each guest and group of the shard near it."""
        found = []
        for leaf, _, visit in self.tree.walk(self.points[:0], guests, self.reach):
            home = self.homes.get(leaf)
            if home is not None:
                for x, y in self._near(guests[visit], self.points[home]):
                    found.append(np.unique(np.column_stack([visit[x], self.label[home[y]]]), axis=0))
        if not found:
            return guests[:0], guests[:0]
        pairs = np.unique(np.concatenate(found), axis=0)
        return guests[pairs[:, 0]], self.points[pairs[:, 1]]

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Links that hold the groups of the shard's own points together."""
        joined = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.points[joined], self.points[self.label[joined]]


def dealt(points: DataFrame, tree: VantageTree, reach: int = MOST_BITS) -> DataFrame:
    """(shard, guest, point): each of ``points`` in its home shard, and as a guest in those it must visit."""
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = batch.column("point").to_numpy(zero_copy_only=False).view(np.uint64)
            for leaf, home, visit in shared.value.walk(own, own[:0], reach):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(home) + len(visit), leaf, np.int32)), pa.array(np.repeat([False, True], [len(home), len(visit)])), pa.array(np.concatenate([own[home], own[visit]]).view(np.int64))], names=["shard", "guest", "point"])

    return points.select("point").mapInArrow(run, "shard int, guest boolean, point long")


def near_points(points: DataFrame, reach: int = MOST_BITS) -> DataFrame:
    """(a, b): links between distinct ``points`` (point) at most ``reach`` bits apart, enough of
    them to connect every group of linked points."""
    spark = points.sparkSession
    total = points.count()
    shards = 1
    while shards < min(max(4 * spark.sparkContext.defaultParallelism, total // SHARD), MOST_SHARDS):
        shards *= 2
    share = min(1.0, SAMPLE * shards / max(1, total))
    sample = points.where(F.pmod(F.xxhash64(F.col("point"), F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    tree = VantageTree(np.sort(sample.toPandas()["point"].to_numpy(np.int64).view(np.uint64)), leaves=shards)

    def search(batches):
        import pyarrow as pa

        now, shard, home = None, None, []

        def out(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            shards, guest = batch.column("shard").to_numpy(), batch.column("guest").to_numpy(zero_copy_only=False)
            point = batch.column("point").to_numpy().view(np.uint64)
            turns = np.flatnonzero((shards[1:] != shards[:-1]) | (guest[1:] != guest[:-1])) + 1
            for part in np.split(np.arange(len(point)), turns):
                if not len(part):
                    continue
                if shards[part[0]] != now:
                    if home:
                        yield out(*Shard(np.concatenate(home), reach).own())
                    elif shard is not None:
                        yield out(*shard.own())
                    now, shard, home = shards[part[0]], None, []
                if not guest[part[0]]:
                    home.append(point[part])
                    continue
                if shard is None:
                    shard, home = Shard(np.concatenate(home) if home else point[:0], reach), []
                yield out(*shard.visited(point[part]))
        if home:
            yield out(*Shard(np.concatenate(home), reach).own())
        elif shard is not None:
            yield out(*shard.own())

    by_shard = dealt(points, tree, reach).repartitionById(tree.n_leaves, "shard").sortWithinPartitions("shard", "guest", "point")
    return by_shard.mapInArrow(search, "a long, b long")


def near_copies(docs: DataFrame, n: int = N, reach: int = MOST_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text)."""
    rows = written(fingerprints(docs, n), "fingerprints")
    points = written(rows.groupBy("point").agg(F.min("doc_id").alias("least")), "points")
    labels = components(near_points(points, reach)).withColumnRenamed("node", "point")
    group = points.join(labels, "point", "left").select("point", "least", F.coalesce("label", "point").alias("label"))
    of_group = group.groupBy("label").agg(F.min("least").alias("component_id"))
    of_point = group.join(of_group, "label").select("point", "component_id")
    shown = F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint")
    return rows.join(of_point, "point").select("doc_id", shown, "component_id")
