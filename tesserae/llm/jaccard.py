"""N-gram Jaccard join in metric space.

Jaccard distance obeys the triangle inequality, so pivots' distances tell which
documents can still be within the radius of each other. Pivots that are
documents cannot split a whole corpus, though: unrelated texts all lie at a
distance near 1 from every pivot. The regions of the first level are therefore
found without distances, and exactly: in any one order of all shingles, two
linked sets share a shingle among the first n - ceil(s n) + 1 of each. Frequent
shingles come last in that order, by a sketch of their counts in the whole
corpus. The documents of a size class (linked sets have like sizes) that share
such a shingle meet at the smallest of them; a document belongs to the region
of each of these, and every linked pair shares a region.

Within a region, parity bits first rule out, by a bound that holds always, the
members that cannot be within the radius of another; only of the rest are the
shingles moved. Then several pivots divide the region into Voronoi cells: a
member belongs to the cell of its nearest pivot and is replicated to each cell
whose pivot is at most two radii farther, since any partner in that cell would
have it there. Members within the radius of a pivot are linked to it. Cells are
divided again in the same way, in tasks of their own as long as they are large
and inside a task below that, until few members are left to compare each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bitmap_of, frugal, materialise, table
from .components import components
from .shingles import Shingler, mix, pack, unpack

#: Words of a shingle, and the similarity of a link in hundredths.
WIDTH, PERCENT = 3, 90
#: Members of a region, or of a tile of a larger one, that one task holds.
TILE = 256
#: Members that are compared each with each without another pivot.
LEAF = 24
#: Pivots of a region, and how often cells of large regions are divided in tasks of their own.
PIVOTS, DEPTH = 8, 4
#: A cell larger than this share of its region is not worth dividing further.
LEAST_SHRINK = 0.7
#: Tiles of a large region whose parities are compared pair by pair.
PARITY_TILES = 64
#: Counters of the frequency sketch, as powers of two: as many as the input asks for, within these.
#: Below the least, a sketch is so much smaller than what its tasks count that the exchange would grow faster than the input.
LEAST_SKETCH_BITS, MOST_SKETCH_BITS = 24, 26
#: Rows of the sketch that one task adds up.
SKETCH_FAN = 64
_OTHER = np.uint64(0x5851F42D4C957F2D)
#: What rounding may add to a distance.
EPSILON = 1e-9


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def size_classes(limit: int = 1 << 40) -> np.ndarray:
    """The largest set size of each class; classes grow by half."""
    tops = [1]
    while tops[-1] < limit:
        tops.append(max(tops[-1] + 1, tops[-1] * 3 // 2))
    return np.array(tops, np.int64)


def prefix_keys(shingles: np.ndarray, levels: np.ndarray, bits: int, tops: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, for its size class and those in which a larger linked set may be."""
    n = len(shingles)
    classes = [int(np.searchsorted(tops, n))]
    while 100 * n >= percent * (int(tops[classes[-1]]) + 1):
        classes.append(classes[-1] + 1)
    rare = shingles[np.argsort(levels[_counter(shingles, bits)], kind="stable")[: prefix_length(n, percent)]]
    return np.concatenate([mix(rare + np.uint64(k)) for k in classes])


def parity_bits(shingles: np.ndarray) -> bytes:
    """One bit for about two shingles: whether an odd number of shingles falls on it.

    Two sets differ in at least as many shingles as their parities differ in bits.
    """
    width = 64
    while width * 2 <= len(shingles):
        width *= 2
    bits = np.bincount((mix(shingles ^ _OTHER) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def may_link(sizes: np.ndarray, parities: list[bytes], percent: int) -> np.ndarray:
    """Which members have another one that neither their sizes nor their parities keep apart; exact, by the bound above."""
    out = np.zeros(len(sizes), bool)
    words = [np.frombuffer(p, np.uint8) for p in parities]
    folded: dict[tuple[int, int], np.ndarray] = {}

    def fold(k: int, width: int) -> np.ndarray:
        # a bit's place modulo a smaller power of two is its place in the narrower parity
        if (k, width) not in folded:
            folded[k, width] = np.bitwise_xor.reduce(words[k].reshape(-1, width), 0)
        return folded[k, width]

    for a in range(1, len(sizes)):
        b = np.flatnonzero((100 * np.minimum(sizes[:a], sizes[a]) >= percent * np.maximum(sizes[:a], sizes[a])))
        if not len(b):
            continue
        most = (sizes[b] + sizes[a]) * (100 - percent) // (100 + percent)
        width = min(len(words[a]), min(len(words[k]) for k in b.tolist()))
        differ = np.bitwise_count(np.stack([fold(k, width) for k in b.tolist()]) ^ fold(a, width)).sum(1, dtype=np.int64)
        near = b[differ <= most]
        out[near] = True
        out[a] |= bool(len(near))
    return out


def _counter(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles >> np.uint64(64 - bits)).astype(np.int64)


def sketch_bits(docs: DataFrame) -> int:
    """Counters for an input of this size: about one for 32 bytes of its files, within fixed bounds.

    With more shingles than counters, a counter tells those apart that occur more often than its average load.
    """
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 60:  # what is not in files has no known size
        return LEAST_SKETCH_BITS
    return max(LEAST_SKETCH_BITS, min(MOST_SKETCH_BITS, size.bit_length() - 5))


def frequency_levels(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    """Half octaves of how many documents have the shingles of each counter, over all documents.

    A byte for each counter for the driver and every task (64 MB at most); a
    task counts up to 255 documents, the sum over tasks goes on. They only order
    shingles; any order is exact. Parts are added up as a tree, so no
    task holds more than ``SKETCH_FAN`` rows of a part, however many tasks there are.
    """
    chunk = 1 << max(bits - 6, 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingler, counts = Shingler(width), np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for text in batch.column("text"):
                at = _counter(shingler.of(text.as_py()), bits)
                counts[at] = np.minimum(counts[at], 254) + 1
        lane = TaskContext.get().partitionId()
        for k, a in enumerate(range(0, len(counts), chunk)):
            some = counts[a : a + chunk].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([lane], pa.int64()), pa.array([pack(some)], pa.binary())], names=["part", "lane", "counts"])

    def total(part: pa.Table) -> np.ndarray:
        out = np.zeros(chunk, np.uint64)
        for counts in part.column("counts"):
            out += unpack(counts.as_py(), np.uint64)
        return out

    def add(part: pa.Table) -> pa.Table:
        return pa.table({"part": part.column("part")[:1], "lane": part.column("lane")[:1], "counts": pa.array([pack(total(part))], pa.binary())})

    def level(part: pa.Table) -> pa.Table:
        octaves = np.floor(2 * np.log2(np.maximum(total(part), 1))).astype(np.uint8)
        return pa.table({"part": part.column("part")[:1], "levels": pa.array([octaves.tobytes()], pa.binary())})

    lanes = docs.rdd.getNumPartitions()
    parts = docs.select("text").mapInArrow(frugal(count), "part int, lane long, counts binary")
    while lanes > SKETCH_FAN:
        lanes = -(-lanes // SKETCH_FAN)
        parts = parts.withColumn("lane", F.pmod("lane", F.lit(lanes))).groupBy("part", "lane").applyInArrow(add, "part int, lane long, counts binary")
    levels = np.zeros(1 << bits, np.uint8)
    for r in parts.groupBy("part").applyInArrow(level, "part int, levels binary").collect():
        levels[r["part"] * chunk : (r["part"] + 1) * chunk] = np.frombuffer(r["levels"], np.uint8)
    return levels


def shingle_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """uid, doc_id, text_hash, n_shingles, fp1, fp2 (of the set) and its prefix, a row for each document."""
    levels, tops = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, width, sketch_bits(docs))), size_classes()
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, level, bits = Shingler(width), levels.value, len(levels.value).bit_length() - 1
        for batch in batches:
            n, fp1, fp2, keys, parity = [], [], [], [], []
            for text in batch.column("text"):
                s = shingler.of(text.as_py())
                n.append(len(s))
                fp1.append(int(mix(s).sum().astype(np.int64)))
                fp2.append(int(mix(s ^ _OTHER).sum().astype(np.int64)))
                parity.append(parity_bits(s))
                keys.append(prefix_keys(s, level, bits, tops, percent).view(np.int64) if len(s) else np.empty(0, np.int64))
            offsets = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*keys, np.empty(0, np.int64)]), pa.int64()))
            keep = [batch.column(c) for c in ("uid", "doc_id", "text_hash")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), lists, pa.array(parity, pa.binary())],
                names=["uid", "doc_id", "text_hash", "n_shingles", "fp1", "fp2", "prefix", "parity"],
            )

    keyed = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return keyed.mapInArrow(frugal(run), f"uid long, doc_id {doc_type}, text_hash long, n_shingles long, fp1 long, fp2 long, prefix array<long>, parity binary")


class Region:
    """Sets of a region side by side, and what is linked among them so far."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.sets, self.percent, self.radius = sets, percent, 1 - percent / 100
        self.root = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def from_pivot(self, pivot: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of ``members`` to a pivot, and which of them are within the radius (in whole numbers)."""
        if not len(members):
            return np.empty(0), np.empty(0, bool)
        p = self.sets[pivot]
        joined, size = np.concatenate([self.sets[m] for m in members]), self.size[members]
        at = np.minimum(np.searchsorted(p, joined), len(p) - 1)
        both = np.add.reduceat((p[at] == joined).astype(np.int64), np.r_[0, np.cumsum(size)[:-1]])
        union = size + len(p) - both
        return 1 - both / union, 100 * both >= self.percent * union

    def link(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.root[max(x, y)] = min(x, y)
            self.links.append((a, b))

    def join(self, members: np.ndarray) -> None:
        """Link all pairs of ``members`` that are within the radius, but for pairs already connected."""
        nobody = members[:0]
        pending = [(members, nobody)]
        while pending:
            inner, window = pending.pop()
            everyone = np.concatenate([inner, window])
            if not len(inner) or len({self.find(m) for m in everyone.tolist()}) < 2:
                continue
            if len(everyone) <= LEAF:
                self.compare(inner, window)
                continue
            distance = self.to_pivots(inner, everyone)
            nearest = distance.argmin(0)
            least = distance[nearest, np.arange(len(everyone))]
            for cell in range(len(distance)):
                mine = nearest[: len(inner)] == cell
                if not mine.any():
                    continue
                # a partner of someone here is at most two radii farther from this pivot than from its own, and one beyond the cell's reach
                reach = distance[cell, : len(inner)][mine].max()
                near = (distance[cell] <= least + 2 * self.radius + EPSILON) & (distance[cell] <= reach + self.radius + EPSILON)
                # of two cells the first compares the members of both
                near[: len(inner)] &= nearest[: len(inner)] > cell
                part = (inner[mine], everyone[near])
                if len(part[0]) + len(part[1]) <= LEAST_SHRINK * len(everyone):
                    pending.append(part)
                else:
                    self.compare(*part)

    def to_pivots(self, inner: np.ndarray, everyone: np.ndarray) -> np.ndarray:
        """Distances of all to pivots of ``inner``, each as far as can be from those before; who is within the radius is linked."""
        rows, least, pivot = [], np.full(len(inner), 2.0), 0
        for _ in range(PIVOTS):
            distance, near = self.from_pivot(int(inner[pivot]), everyone)
            for m in everyone[near].tolist():
                self.link(int(inner[pivot]), m)
            rows.append(distance)
            least = np.minimum(least, distance[: len(inner)])
            pivot = int(least.argmax())
            if least[pivot] <= EPSILON:
                break
        return np.stack(rows)

    def compare(self, inner: np.ndarray, window: np.ndarray) -> None:
        """Each of ``inner`` with all others that it isn't connected to yet."""
        everyone = np.concatenate([window, inner])
        for k in range(len(inner)):
            me = int(inner[k])
            mine = self.find(me)
            before = everyone[: len(window) + k]
            size, n = self.size[before], self.size[me]
            before = before[100 * np.minimum(size, n) >= self.percent * np.maximum(size, n)]
            rest = np.array([m for m in before.tolist() if self.find(m) != mine], np.int64)
            _, near = self.from_pivot(me, rest)
            for m in rest[near].tolist():
                self.link(me, m)


def link_table(uids: list[int], links: list[tuple[int, int]]) -> pa.Table:
    a, b = [uids[x] for x, _ in links], [uids[y] for _, y in links]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def without_far(members: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """``members`` (pivot, uid) without those whose parities show that they link with no one in their region.

    The members of a larger region than a task holds are dealt into tiles that
    meet pair by pair; regions of over ``PARITY_TILES`` tiles are left as they are.
    """
    counted = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"))
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    sized = members.join(counted, "pivot").withColumn("tiles", tiles)
    facts = rows.select("uid", "n_shingles", "parity")

    def prune(region: pa.Table) -> pa.Table:
        region = region.sort_by("uid")
        keep = may_link(region.column("n_shingles").to_numpy(), region.column("parity").to_pylist(), percent)
        return region.select(["pivot", "uid"]).filter(pa.array(keep))

    kept = sized.where("tiles = 1").join(facts, "uid").groupBy("pivot").applyInArrow(prune, "pivot long, uid long")
    dealt = sized.where((F.col("tiles") > 1) & (F.col("tiles") <= PARITY_TILES)).join(facts, "uid")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    near = met.groupBy("pivot", "low", "high").applyInArrow(prune, "pivot long, uid long").distinct()
    return kept.unionAll(near).unionAll(sized.where(F.col("tiles") > PARITY_TILES).select("pivot", "uid"))


def region_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect all pairs within the radius in the regions ``members`` (pivot, uid).

    Regions of up to ``TILE`` members are joined in a task. Larger ones are
    divided into the Voronoi cells of their pivots, which are regions in turn;
    where cells stay as large as their region, its tiles are compared.
    """

    def join_region(region: pa.Table) -> pa.Table:
        rows = sorted(dict(zip(region.column("uid").to_pylist(), region.column("shingles").to_pylist())).items())
        uids = [u for u, _ in rows]
        r = Region([np.frombuffer(s, np.uint64) for _, s in rows], percent)
        r.join(np.arange(len(rows)))
        return link_table(uids, r.links)

    found = []
    regions = members.select(F.col("pivot").alias("region"), "uid")
    for depth in range(DEPTH + 1):
        counted = regions.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("uid").alias("pivot"))
        sized = materialise(regions.join(counted, "region"), "regions")
        small = sized.where(F.col("size") <= TILE).join(sets, "uid").select("region", "uid", "shingles")
        found.append(small.groupBy("region").applyInArrow(join_region, "a long, b long"))
        large = sized.where(F.col("size") > TILE)
        if large.isEmpty():
            break
        if depth == DEPTH:
            found.append(large_region_links(large, sets, percent))
            break
        cells = materialise(voronoi_cells(large, sets, percent), "cells")
        found.append(cells.where("linked").select(F.col("pivot").alias("a"), F.col("uid").alias("b")))
        counted = cells.where("NOT linked").groupBy("region", "pivot").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
        stuck = counted.where((F.col("n") > TILE) & (F.col("n") > F.col("size") * LEAST_SHRINK)).select("region").distinct()
        stuck = materialise(stuck, "stuck")
        if not stuck.isEmpty():
            found.append(large_region_links(large.join(stuck, "region", "left_semi"), sets, percent))
        inside = cells.where("NOT linked").join(stuck, "region", "left_anti")
        regions = inside.select(F.xxhash64("region", "pivot").alias("region"), "uid")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def voronoi_cells(regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """region, size, pivot, uid, linked: the members of each Voronoi cell with its replicated boundary, and who is within the radius of a pivot.

    Input: region, pivot, uid, size. About ``PIVOTS`` members of a region, by
    hash, are its pivots, and always the one it has. They go to each of the
    tasks that a region's members are dealt over.
    """
    every = F.ceil(F.col("size") / (PIVOTS - 1))
    dealt = regions.withColumn("chunks", F.ceil(F.col("size") / TILE).cast("int"))
    picked = dealt.where((F.col("uid") == F.col("pivot")) | (F.pmod(F.xxhash64("region", "uid"), every) == 0))
    picked = picked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    names = ["region", "size", "chunk", "uid", "is_pivot"]
    both = dealt.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int")).withColumn("is_pivot", F.lit(False)).select(*names)
    both = both.unionAll(picked.withColumn("is_pivot", F.lit(True)).select(*names)).join(sets, "uid")

    def assign(chunk: pa.Table) -> pa.Table:
        rows = sorted(set(zip(chunk.column("is_pivot").to_pylist(), chunk.column("uid").to_pylist(), chunk.column("shingles").to_pylist())))
        members = [r for r in rows if not r[0]]
        pivots = rows[len(members) :]
        r = Region([np.frombuffer(s, np.uint64) for _, _, s in members + pivots], percent)
        measured = [r.from_pivot(len(members) + k, np.arange(len(members))) for k in range(len(pivots))]
        distance, near = np.stack([d for d, _ in measured]), np.stack([n for _, n in measured])
        cell = distance <= distance.min(0) + 2 * r.radius + EPSILON
        out = [(int(p), int(m), linked) for linked, table in ((False, cell), (True, near)) for p, m in zip(*np.nonzero(table))]
        return pa.table({
            "region": pa.array([chunk.column("region")[0].as_py()] * len(out), pa.int64()), "size": pa.array([chunk.column("size")[0].as_py()] * len(out), pa.int64()),
            "pivot": pa.array([pivots[p][1] for p, _, _ in out], pa.int64()), "uid": pa.array([members[m][1] for _, m, _ in out], pa.int64()),
            "linked": pa.array([x for _, _, x in out], pa.bool_()),
        })

    return both.groupBy("region", "chunk").applyInArrow(assign, "region long, size long, pivot long, uid long, linked boolean")


def large_region_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The same for regions (region, pivot, uid) that pivots do not divide.

    Shells of half a radius around the pivot are dealt into tiles; tiles meet if
    a pair of their shells may be within the radius of each other. Members
    inside the radius are linked to the pivot and not compared among themselves.
    """
    half = (1 - percent / 100) / 2
    radius_cell = 1  # shells 0 and 1 lie inside the radius

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shell = []
            for mine, other in zip(batch.column("shingles"), batch.column("pivot_shingles")):
                r = Region([np.frombuffer(other.as_py(), np.uint64), np.frombuffer(mine.as_py(), np.uint64)], percent)
                d, near = r.from_pivot(0, np.array([1]))
                shell.append(min(int(d[0] / half), radius_cell) if near[0] else max(int(d[0] / half), radius_cell + 1))
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("pivot"), batch.column("uid"), pa.array(shell, pa.int32())], names=["region", "pivot", "uid", "shell"])

    pivots = sets.select(F.col("uid").alias("pivot"), F.col("shingles").alias("pivot_shingles"))
    with_sets = members.select("region", "pivot", "uid").join(sets, "uid").join(pivots, "pivot")
    shells = materialise(with_sets.mapInArrow(measure, "region long, pivot long, uid long, shell int").distinct(), "shells")
    inner = shells.where(F.col("shell") <= radius_cell).select(F.col("pivot").alias("a"), F.col("uid").alias("b"))
    counts = shells.groupBy("region", "shell").agg(F.count(F.lit(1)).alias("rows"))
    tiles = counts.select("region", "shell", F.ceil(F.col("rows") / TILE).cast("int").alias("tiles"))
    tiled = shells.join(tiles, ["region", "shell"]).withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int"))
    each = tiles.select("region", "shell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    other = each.select("region", F.col("shell").alias("shell2"), F.col("tile").alias("tile2"))
    # shells i < j are at least (j - i - 1) half radii apart
    meet = each.join(other, "region").where(
        (F.struct("shell", "tile") <= F.struct("shell2", "tile2")) & (F.col("shell2") - F.col("shell") <= 3) & (F.col("shell2") > radius_cell)
    )
    meet = meet.withColumn("pair", F.xxhash64("region", "shell", "tile", "shell2", "tile2"))
    sides = meet.select("region", "shell", "tile", "pair").unionAll(
        meet.where((F.col("shell") != F.col("shell2")) | (F.col("tile") != F.col("tile2"))).select(
            "region", F.col("shell2").alias("shell"), F.col("tile2").alias("tile"), "pair"
        )
    )
    rows = tiled.join(sides, ["region", "shell", "tile"]).join(sets, "uid").select("pair", "uid", "shell", "shingles")

    def join_tiles(pair: pa.Table) -> pa.Table:
        found = sorted(set(zip(pair.column("uid").to_pylist(), pair.column("shell").to_pylist(), pair.column("shingles").to_pylist())))
        r = Region([np.frombuffer(s, np.uint64) for _, _, s in found], percent)
        inside = [k for k, (_, shell, _) in enumerate(found) if shell <= radius_cell]
        for k in inside[1:]:
            r.root[r.find(k)] = r.find(inside[0])  # they are connected through the pivot
        r.join(np.arange(len(found)))
        return link_table([u for u, _, _ in found], r.links)

    return inner.unionAll(rows.groupBy("pair").applyInArrow(join_tiles, "a long, b long"))


#: What tells sets of shingles apart.
KEY = ("n_shingles", "fp1", "fp2")


def jaccard_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Near-duplicate classes by the Jaccard similarity of shingle sets, joined exactly.

    Output, a row for each row of ``docs``: uid, doc_id, text_hash, n_shingles,
    component_id (the smallest doc_id reachable by links, its own included).

    * Null and empty texts, and texts of white space, have no shingles and link
      with nothing; a text of fewer words than the width is one shingle.
    * Repeated rows and equal sets are one node of the join, whatever their
      number. A null doc_id is larger than any other.
    * Extra columns are ignored; an empty table gives no rows.
    """
    rows, classes = _classes(docs, width, percent)
    return rows.join(classes.drop("class"), [*KEY], "left").select(
        "uid", "doc_id", "text_hash", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the documents, and for each set its class (the smallest node reachable by links) and component_id."""
    rows = materialise(shingle_rows(docs, width, percent), "shingled")
    groups = rows.where("n_shingles > 0").groupBy(*KEY).agg(
        F.min("uid").alias("rep"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")
    )
    groups = materialise(groups, "sets")
    # sets too small to differ and still be linked need no join
    joined = groups.where(F.col("n_shingles") >= percent // (100 - percent)).select(F.col("rep").alias("uid"))
    prefixes = rows.join(joined, "uid", "left_semi").select("uid", F.explode("prefix").alias("shingle"))
    shared = prefixes.groupBy("shingle").agg(F.min("uid").alias("pivot"), F.max("uid").alias("last")).where("last > pivot").select("shingle", "pivot")
    members = materialise(prefixes.join(shared, "shingle").select("pivot", "uid").distinct(), "members")
    members = materialise(without_far(members, rows, percent), "near-members")
    needed = rows.join(members.select("uid").distinct(), "uid", "left_semi").select("uid", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))

    def make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            made = [shingler.of(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(made, pa.binary())], names=["uid", "shingles"])

    hashed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    hashed = hashed.where(bitmap_of(needed, "_hash")("text_hash"))
    texts = hashed.join(needed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    # repeated rows give a set more than once; tasks key sets by uid
    sets = texts.select("uid", "text").mapInArrow(frugal(make_sets), "uid long, shingles binary")
    sets = materialise(sets, "shingle-sets")
    links = materialise(region_links(members, sets, percent), "links")
    roots = components(links)
    least = roots.join(groups.select(F.col("rep").alias("node"), "least_id"), "node")
    ids = least.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_node = least.join(ids, "root").select(F.col("node").alias("rep"), "root", "component_id")
    classes = groups.join(by_node, "rep", "left")
    return rows, classes.select(*KEY, F.coalesce("root", "rep").alias("class"), F.coalesce("component_id", "least_id").alias("component_id"))


def drop_near(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each group: the one with the smallest doc_id, null being the largest; documents without words all stay.

    Groups are classes of linked texts, whatever their ids: rows of one id or
    of none are told apart by their texts, and of repeated rows one stays. All
    columns are kept, whatever their names; an empty table gives no rows.
    """
    rows, classes = _classes(docs, width, percent)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid", "text_hash")).alias("least")
    of_set = rows.where("n_shingles > 0").groupBy(*KEY).agg(least)
    keep = of_set.join(classes, [*KEY]).groupBy("class").agg(F.min("least").alias("least"))
    id_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keep = keep.select(F.col("least.unnamed").alias("unnamed"), id_text("least.doc_id").alias("id"), F.col("least.text_hash").alias("text_hash"))
    with_words = F.coalesce(F.col("text").rlike(r"[^\x09-\x0D\x20]"), F.lit(False))
    hashed = docs.where(with_words).select(
        F.struct("*").alias("row"), F.col("doc_id").isNull().alias("unnamed"), id_text("doc_id").alias("id"), F.xxhash64("text").alias("text_hash")
    )
    names = ["unnamed", "id", "text_hash"]
    one = F.row_number().over(Window.partitionBy(*names).orderBy(*names)).alias("place")
    kept = hashed.join(keep, names, "left_semi").select("row", one).where("place = 1")
    return kept.select("row.*").unionAll(docs.where(~with_words))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
