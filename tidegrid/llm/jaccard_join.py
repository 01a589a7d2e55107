"""Exact similarity join of documents on word shingles in the metric space of Jaccard distance.

Two documents link when their distance is at most ``r`` = 1 - threshold.

1. Candidates.  Nearly all documents of a corpus are at distance 1 from each other, so pivots alone would leave all of them
   in one region at first.  Sizes of linked sets differ by a factor of 1 / threshold at most, and at most ``tau`` shingles
   lie outside of both; all shingles are dealt into more than ``tau`` classes by hash, so linked sets agree entirely in
   some classes.  Documents with the same part of a class (on the level of their size, or as a boundary document on the
   next one) form a group.  Pairs of groups of up to SMALL documents are counted; linked sets of sizes x and y differ
   in at most (1 - t) / (1 + t) * (x + y) classes, so a pair that shares fewer groups is no link; the others are measured.
2. Stars.  In a larger group every document is measured against the group's least document, its pivot; groups with the same
   pivot are one region.  What links so far is one component; a region within one component is done.  The others are
   joined by more pivots:
3. Voronoi regions.  A region of more than LEAF documents gets PIVOTS pivots.  A document is at home in the region of
   the nearest pivot, or in the far region if none is nearer than 1 - 3 r.
4. Windows of the triangle inequality.  If x is at home with pivot p and links with y, then d(y, p) <= d(y, home of y)
   + 2 r, so y is also replicated to every region whose pivot is within that window; a document at home at distance
   1 - 4 r or more is replicated to the far region.  So every link lies in a region where one of its ends is at home.
5. Recursion.  Documents within r of the same pivot are one component already; only pairs of different components need
   to be compared.  A region is parted again as long as that halves the comparisons left, with other pivots; then its
   documents that are not of its largest component are joined with all its members, block by block.

Empty classes would be groups of unrelated documents, and classes of nothing but common shingles (found in a
sample) groups of documents that share a passage.  The number of classes exceeds ``tau`` by a slack, and a document leaves
out as many such classes as the slack allows, empty ones first, then those whose rarest shingle is the most common; then
others in common remain.  So the sample, one document in SHARE, decides on the size of groups only, not on results.
Documents with equal sets are one node (a 64-bit digest) throughout.  Every link is decided on whole texts.

Defined results: null texts and texts without words have no shingles and no link; repeated rows are copies; texts of any
length are taken whole; an empty table gives an empty result; further columns of documents are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HASH_SLICE, by_bucket, materialize, mix64, partitions, released, shuffles_removed, slices
from .components import components
from .shingles import set_digest, shingle_sets

WORDS = 5
THRESHOLD = 80
#: Documents, and shingles of theirs, of a block; two blocks are compared at a time.
BLOCK, WEIGHT = 2000, 1_500_000
#: Documents of a region that is not parted any more, pivots of one that is, and documents that meet its pivots in one task.
LEAF, PIVOTS, DEAL = 2000, 32, 4000
#: Documents of a group whose pairs are all counted.
SMALL = 24
#: Documents to compare whose numbers are broadcast, 16 bytes each, so that other texts are not moved; more are joined without
#: a hint, which moves all texts once.
MOST_BROADCAST = 1_000_000
#: Members that so many sets have are counted pair by pair.
FEW = 16
#: Keys and pairs that a task holds before it hands them on; they bound its memory only.
HELD_KEYS, HELD_PAIRS = 800_000, 400_000
#: Members of two blocks that are put in order at a time, columns of an incidence matrix, and rows of a block that are
#: compared with another block at a time; they bound memory only.
HELD_MEMBERS, COLUMNS, STRIP = 400_000, 512, 256
#: Classes beyond what the differences and the slack need, as a share of tau: pairs must share so many regions more.
EXTRA = 0.15
#: Shingles of one document in SHARE are counted to find common ones, of more where there are fewer than SAMPLE; how many of
#: these make a shingle common, and the most that are kept, the most frequent first (they decide on the size of groups only).
SHARE, SAMPLE, COMMON, MOST_COMMON = 16, 8192, 3, 1 << 17
_U = np.uint64
_ENTRY = np.dtype([("key", "<u8"), ("node", "<i8")])
_COMMON = np.dtype([("shingle", "<u8"), ("times", "<i8")])


class Levels:
    """Sizes in steps of 100 / percent; for each step the number of classes and the slack."""

    def __init__(self, percent: int):
        self.percent, self.first, self.classes, self.slack, self.shared = percent, [1], [], [], []
        ratio = 100 / percent if percent < 100 else 2.0
        while self.first[-1] < 2**40:
            self.first.append(math.ceil(ratio ** len(self.first)))
        for j in range(len(self.first) - 1):
            most = max(1, self.first[j + 1] - 1)
            tau = (100 - percent) * 2 * most // (100 + percent)
            smallest = max(1, self.first[max(0, j - 1)])
            slack = 0 if tau == 0 else 2 + math.ceil(tau * (0.08 + 1.3 * math.exp(-smallest / (tau + 1))))
            extra = math.ceil(EXTRA * tau)
            self.classes.append(tau + 1 + slack + extra)
            self.slack.append(slack)
            self.shared.append(tau + 1 + extra)

    def of(self, n: int) -> list[int]:
        own = int(np.searchsorted(self.first, n, side="right")) - 1
        return [own] if self.percent == 100 else [own, own + 1]


    def possible(self, x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Whether sets of these sizes that share so many regions can be linked."""
        level = np.searchsorted(self.first, np.maximum(x, y), side="right") - 1
        differ = (100 - self.percent) * (x + y) // (100 + self.percent)
        return (100 * np.minimum(x, y) >= self.percent * np.maximum(x, y)) & (times >= np.array(self.shared)[level] - differ)


def class_keys(members: np.ndarray, levels: Levels, common: np.ndarray) -> np.ndarray:
    """Keys of a set's parts of all classes of its levels; ``common`` holds the sorted common shingles with their counts.

    What is left out depends on the parts alone: of two sets that agree in a class, the one that leaves out more of the
    classes they agree in leaves out all that the other does, so at most ``slack`` of these are missing.
    """
    times = np.zeros(len(members), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common["shingle"], members), len(common) - 1)
        times = np.where(common["shingle"][at] == members, common["times"][at], 0)
    where, value = mix64(members ^ _U(0x2545F4914F6CDD1D)) >> _U(32), mix64(members + _U(0x5851F42D4C957F2D))
    out = []
    for level in levels.of(len(members)):
        m, slack = levels.classes[level], levels.slack[level]
        cls = (where * _U(m) >> _U(32)).astype(np.int64)
        order = np.argsort(cls, kind="stable")
        found, first = np.unique(cls[order], return_index=True)
        sums, seldom = np.zeros(m, np.uint64), np.full(m, np.iinfo(np.int64).max)
        sums[found] = np.add.reduceat(value[order], first)
        seldom[found] = np.minimum.reduceat(times[order], first)
        keys = mix64(sums + np.arange(m).astype(np.uint64) * _U(0xD1342543DE82EF95) + _U(level << 48))
        weak = np.flatnonzero(seldom)
        if len(weak) > slack:
            weak = weak[np.lexsort((keys[weak], seldom[weak]))[len(weak) - slack :]]
        out.append(np.delete(keys, weak))
    return np.concatenate(out)


def _measure(words: int) -> Callable:
    @released
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HASH_SLICE):
                sets = shingle_sets(part.column("text").to_pylist(), words)
                n, node = [len(x) for x in sets], [set_digest(x) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(n, pa.int64()), pa.array(node, pa.int64())], names=["doc_id", "row_key", "n_shingles", "node"])

    return measure


def _pack(entries: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Entries by node: nodes, keys of each, and 48 bits of each key (the bucket holds further ones)."""
    entries = entries[np.argsort(entries["node"], kind="stable")]
    node, times = np.unique(entries["node"], return_counts=True)
    key = entries["key"]
    return node.tobytes(), times.astype("<u4").tobytes(), (key >> _U(32)).astype("<u4").tobytes(), (key >> _U(16)).astype("<u2").tobytes()


def _unpack(nodes: bytes, times: bytes, high: bytes, low: bytes) -> np.ndarray:
    key = np.frombuffer(high, "<u4").astype(np.uint64) << _U(16) | np.frombuffer(low, "<u2").astype(np.uint64)
    out = np.empty(len(key), _ENTRY)
    out["key"], out["node"] = key, np.repeat(np.frombuffer(nodes, "<i8"), np.frombuffer(times, "<u4"))
    return out


_BLOCK = ("bucket", "kind", "nodes", "times", "high", "low")


def _count_shingles(words: int) -> Callable:
    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x for part in slices(batch, "text", HASH_SLICE) for x in shingle_sets(part.column("text").to_pylist(), words)]
            if sets:
                found, times = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], names=["shingle", "times"])

    return count


def _few(keys: DataFrame) -> DataFrame:
    """Broadcast in joins with texts if there are at most MOST_BROADCAST."""
    return F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys


def common_shingles(keyed: DataFrame, nodes: DataFrame, words: int) -> np.ndarray:
    """Sorted shingles of COMMON different sets at least in a sample, with their counts; MOST_COMMON at most, 2 MB."""
    share = min(SHARE, max(1, nodes.count() // SAMPLE))
    chosen = nodes.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).select("row_key")
    texts = keyed.select("row_key", "text").where(F.col("text").isNotNull()).join(_few(chosen), "row_key").dropDuplicates(["row_key"])
    counted = texts.select("text").mapInArrow(_count_shingles(words), "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("n"))
    top = counted.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "shingle").limit(MOST_COMMON)
    with shuffles_removed(keyed.sparkSession):
        rows = top.collect()
    common = np.empty(len(rows), _COMMON)
    common["shingle"], common["times"] = np.array([r["shingle"] for r in rows], np.int64).view(np.uint64), [r["n"] for r in rows]
    return np.sort(common, order="shingle")


def _emit_keys(words: int, percent: int, buckets: int, shared) -> Callable:
    """Blocks of (key, node) for the bucket of the key, of kind 0.  Of a key that a batch holds more than SMALL times one
    node goes there, of kind 1; the others go to buckets of the nodes, of kind 2, as they are in a large group anyway."""
    levels = Levels(percent)

    def close(blocks: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(blocks)
        blocks.clear()
        every = every[np.lexsort((every["node"], every["key"]))]
        new = np.concatenate([[True], every["key"][1:] != every["key"][:-1]])
        group = np.cumsum(new) - 1
        many = (np.bincount(group) > SMALL)[group]
        out = []
        for kind, chosen in ((0, every[~many]), (1, every[many & new])):
            out += [(b, kind, *_pack(chosen[x])) for b, x in by_bucket(chosen["key"], buckets)]
        rest, own = every[many & ~new]["node"], every[many & ~new]["key"] >> _U(16)
        out += [(b, 2, rest[x].tobytes(), b"", own[x].tobytes(), b"") for b, x in by_bucket(rest.view(np.uint64), buckets)]
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=_BLOCK)

    @released
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            blocks, seen, held = [], set(), 0
            for part in slices(batch, "text", HASH_SLICE):
                for members in shingle_sets(part.column("text").to_pylist(), words):
                    node = set_digest(members)
                    if len(members) and node not in seen:
                        seen.add(node)
                        keys = class_keys(members, levels, common)
                        own = np.empty(len(keys), _ENTRY)
                        own["key"], own["node"] = keys, node
                        blocks.append(own)
                        held += len(keys)
                if held > HELD_KEYS:
                    yield close(blocks)
                    held = 0
            if blocks:
                yield close(blocks)

    return emit


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return _rows(a[first], b[first], np.diff([*first, len(a)]))


def _rows(a: np.ndarray, b: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64, copy=False)) for x in (a, b, times)], names=["a", "b", "times"])


@released
def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, times): pairs of small groups with how many they share here, or key, node and 0 of large groups.

    Blocks stay packed until their bucket's turn, one bucket at a time.
    """
    packed: dict[int, list[tuple]] = {}
    for batch in batches:
        for bucket, kind, *block in zip(*(batch.column(k).to_pylist() for k in _BLOCK)):
            if kind == 2:
                key, node = np.frombuffer(block[2], "<i8"), np.frombuffer(block[0], "<i8")
                yield _rows(key, node, np.zeros(len(key)))
            else:
                packed.setdefault(bucket, []).append((kind, *block))
    while packed:
        _, blocks = packed.popitem()
        every = [_unpack(*block) for _, *block in blocks]
        frequent = np.repeat([kind == 1 for kind, *_ in blocks], [len(x) for x in every])
        every = np.concatenate(every)
        del blocks
        order = np.lexsort((every["node"], every["key"]))
        key, node, frequent = every["key"][order], every["node"][order], frequent[order]
        del every, order
        new = np.concatenate([[True], key[1:] != key[:-1]])
        frequent = np.logical_or.reduceat(frequent, np.flatnonzero(new))
        once = new | np.concatenate([[True], node[1:] != node[:-1]])  # copies of a text in other batches are one node
        key, node, first = key[once], node[once], np.flatnonzero(new[once])
        size = np.diff([*first, len(key)])
        large = (size > SMALL) | frequent
        of = np.repeat(np.arange(len(first)), size)
        yield _rows(key[large[of]].view(np.int64), node[large[of]], np.zeros(large[of].sum()))
        del key, frequent, new, once, of
        one, two, held = [], [], 0
        for s in range(2, SMALL + 1):
            own = first[(size == s) & ~large]
            i, j = np.triu_indices(s, 1)
            step = max(1, HELD_PAIRS // len(i))
            for at in range(0, len(own), step):
                x, y = node[own[at : at + step, None] + i].ravel(), node[own[at : at + step, None] + j].ravel()
                one.append(x[x != y])
                two.append(y[x != y])
                held += len(one[-1])
                if held >= HELD_PAIRS:
                    yield _pairs(np.concatenate(one), np.concatenate(two))
                    one, two, held = [], [], 0
        if held:
            yield _pairs(np.concatenate(one), np.concatenate(two))


def _possible(percent: int) -> Callable:
    levels = Levels(percent)

    @released
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = levels.possible(*(batch.column(k).to_numpy() for k in ("n_a", "n_b", "times")))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return check


def _decide(words: int) -> Callable:
    """Sizes of intersection and union of two texts' sets."""

    @released
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", HASH_SLICE):
                one, two = (shingle_sets(part.column(k).to_pylist(), words) for k in ("text_a", "text_b"))
                both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(one, two)]
                union = [len(x) + len(y) - n for x, y, n in zip(one, two, both)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(both, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "both", "either"])

    return decide


def _measured(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    side = lambda k: texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return materialize(full.mapInArrow(_decide(words), "a long, b long, both long, either long"))


_REGION = "parent long, region long, node long, n_shingles long, home boolean, label long"
_LINKS = "a long, b long"


def _shared(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other.

    Members that the same sets have count together.  What up to FEW sets have goes pair by pair, the rest by products of
    incidence matrices.  Sets are sorted, so members are taken range by range, about HELD_MEMBERS at a time.
    """
    both = np.zeros((len(one), len(two)), np.int32)
    if not len(one) or not len(two):
        return both
    sets = one + two
    parts = 1 + sum(map(len, sets)) // HELD_MEMBERS
    cuts = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    places = [[0, *np.searchsorted(x, cuts).tolist(), len(x)] for x in sets]
    for k in range(parts):
        _add_shared(both, [x[at[k] : at[k + 1]] for x, at in zip(sets, places)])
    return both


def _add_shared(both: np.ndarray, sets: list[np.ndarray]) -> None:
    """Adds the sizes of the intersections of the first sets, one for each row of ``both``, with the others."""
    n_one, n_two = both.shape
    sizes = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    if not len(every):
        return
    order = np.argsort(every, kind="stable")
    every = every[order]
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    size = np.diff(np.append(first, len(row)))
    row, size = row[np.repeat(size > 1, size)], size[size > 1]
    if not len(size):
        return
    first = np.cumsum(size) - size
    _, kind, weight = np.unique(np.add.reduceat(mix64(row + 1), first), return_index=True, return_counts=True)
    first, size, weight = first[kind], size[kind], weight.astype(np.int32)
    flat = both.reshape(-1)
    for s in range(2, FEW + 1):
        own, times = first[size == s], weight[size == s]
        i, j = np.triu_indices(s, 1)
        step = max(1, HELD_PAIRS // len(i))
        for at in range(0, len(own), step):
            rows = row[own[at : at + step, None] + np.arange(s)]
            x, y, w = rows[:, i].ravel(), rows[:, j].ravel(), np.repeat(times[at : at + step], len(i))
            cross = (x < n_one) & (y >= n_one)
            np.add.at(flat, x[cross].astype(np.int64) * n_two + (y[cross] - n_one), w[cross])
    many = np.flatnonzero(size > FEW)
    for at in range(0, len(many), COLUMNS):
        own = many[at : at + COLUMNS]
        dense = np.zeros((len(sizes), len(own)), np.float32)
        for k, m in enumerate(own.tolist()):
            dense[row[first[m] : first[m] + size[m]], k] = 1
        other = (dense[n_one:] * weight[own].astype(np.float32)).T
        for a in range(0, n_one, STRIP):
            z = min(a + STRIP, n_one)
            both[a:z] += (dense[a:z] @ other).astype(np.int32)


def assign(members: np.ndarray, elements: np.ndarray, incidence: np.ndarray, sizes: np.ndarray, r: float) -> tuple[int, np.ndarray, np.ndarray]:
    """Home of a set among the pivots (their number stands for the far region), all regions that it takes part in (its
    home first), and its distances to the pivots."""
    at = np.minimum(np.searchsorted(elements, members), len(elements) - 1)
    both = incidence[at[elements[at] == members]].sum(axis=0)
    away = 1 - both / (len(members) + sizes - both)
    home, far = int(away.argmin()), len(sizes)
    near = 1 - 3 * r
    if away[home] > near:
        return far, np.array([far]), away
    regions = np.flatnonzero(away <= away[home] + 2 * r + 1e-9)
    border = [far] if away[home] >= near - r - 1e-9 else []
    return home, np.concatenate([[home], regions[regions != home], border]).astype(int), away


def _assign(words: int, percent: int) -> Callable:
    """Deals the members of regions to the regions of their pivots, which come first in each part of a region.

    A member is labelled by the component of the pivot that it links with; kind 1 rows are links with pivots.
    """
    r = (100 - percent) / 100

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, labels, sets, ready = None, [], [], [], None
        for batch in batches:
            for part in slices(batch, "text", HASH_SLICE):
                out = []
                rows = zip(*(part.column(k).to_pylist() for k in ("region", "salt", "pivot", "node", "n_shingles", "home", "label")), shingle_sets(part.column("text").to_pylist(), words))
                for region, salt, pivot, node, n, home, label, members in rows:
                    if (region, salt) != key:
                        key, nodes, labels, sets, ready = (region, salt), [], [], [], None
                    if pivot:
                        nodes.append(node)
                        labels.append(label)
                        sets.append(members)
                        continue
                    if ready is None:
                        elements = np.unique(np.concatenate(sets))
                        incidence = np.zeros((len(elements), len(sets)), np.int32)
                        for k, x in enumerate(sets):
                            incidence[np.searchsorted(elements, x), k] = 1
                        ready = elements, incidence, np.array([len(x) for x in sets])
                    own, regions, away = assign(members, *ready, r)
                    linked = 100 * (1 - away) >= percent - 1e-9
                    out += [(region, None, node, None, None, nodes[k]) for k in np.flatnonzero(linked).tolist() if nodes[k] != node]
                    for k in regions.tolist():
                        child = int(mix64(np.array([region, nodes[k] if k < len(nodes) else 0], np.int64).view(np.uint64) * np.array([3, 5], np.uint64)).sum(dtype=np.uint64).view(np.int64))
                        known = label if label != node or k == len(nodes) or not linked[k] else labels[k]
                        out.append((region, child, node, n, home and k == own, known))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in _REGION.split(", ")])

    return run


def _part(members: DataFrame, texts: DataFrame, words: int, percent: int, level: int, n: int) -> DataFrame:
    """Regions (rows of _REGION) of the members (region, size, node, n_shingles, home, label); rows with a null region are
    links of node with label."""
    place = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(level)), "node"))
    parts = F.ceil(F.col("size") / DEAL).cast("long")
    columns = ["region", "salt", "pivot", "node", "n_shingles", "home", "label"]
    chosen = members.select("region", "size", "node").withColumn("place", place).where(F.col("place") <= PIVOTS).select("region", "node")
    pivots = members.join(chosen, ["region", "node"], "left_semi").withColumn("pivot", F.lit(True)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = members.withColumn("pivot", F.lit(False)).withColumn("salt", F.pmod(F.xxhash64("node"), parts)).select(columns).unionByName(pivots.select(columns))
    dealt = rows.join(texts, "node").repartition(n, "region", "salt").sortWithinPartitions("region", "salt", F.desc("pivot"))
    return materialize(dealt.mapInArrow(_assign(words, percent), _REGION))


def _sized(members: DataFrame, *by: str) -> DataFrame:
    """Of each region: size, its largest component (core), members and shingles outside of it, and comparisons left."""
    labels = members.groupBy("region", "label", *by).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    sizes = labels.groupBy("region", *by).agg(F.sum("n").alias("size"), F.sum("w").alias("weight"), F.max(F.struct("n", "label", "w")).alias("most"))
    left = sizes.select("region", *by, "size", "weight", F.col("most.label").alias("core"), (F.col("size") - F.col("most.n")).alias("open"), (F.col("weight") - F.col("most.w")).alias("open_weight"))
    return left.withColumn("cost", F.col("open").cast("double") * F.col("size"))


def _join_blocks(words: int, percent: int) -> Callable:
    """Links between components: the open members of a block with all members of a chunk; rows come sorted by them."""

    @released
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def close() -> Iterator[pa.RecordBatch]:
            left, right = [x for x in rows if x[0]], [x for x in rows if x[1]]
            if not left or not right:
                return
            (_, _, node_l, home_l, label_l, sets_l), (_, _, node_r, home_r, label_r, sets_r) = zip(*left), zip(*right)
            both = _shared(list(sets_l), list(sets_r))
            size_l, size_r = (np.array([len(x) for x in own]) for own in (sets_l, sets_r))
            node_l, node_r, home_l, home_r, label_l, label_r = map(np.array, (node_l, node_r, home_l, home_r, label_l, label_r))
            linked = np.zeros(both.shape, bool)
            for at in range(0, len(left), STRIP):
                z = slice(at, at + STRIP)
                same = both[z].astype(np.int64)
                found = (100 * same >= percent * (size_l[z, None] + size_r - same)) & (same > 0) & (node_l[z, None] != node_r)
                linked[z] = found & (label_l[z, None] != label_r) & (home_l[z, None] | home_r)
            del both
            a, b = [], []
            new_l, new_r = linked.any(axis=1), linked.any(axis=0)
            for seed in np.flatnonzero(new_l).tolist():
                front = np.zeros(len(node_l), bool)
                front[seed] = new_l[seed]
                while front.any():  # what is reached from the seed links with it through others; one link each will do
                    new_l &= ~front
                    met = linked[front].any(axis=0) & new_r
                    new_r &= ~met
                    front = linked[:, met].any(axis=1) & new_l
                    found = np.concatenate([node_r[met], node_l[front]])
                    a.append(np.full(len(found), node_l[seed]))
                    b.append(found)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            for part in slices(batch, "text", HASH_SLICE):
                own = shingle_sets(part.column("text").to_pylist(), words)
                for *now, left, right, node, home, label, members in zip(*(part.column(k).to_pylist() for k in ("region", "block", "chunk", "left", "right", "node", "home", "label")), own):
                    if now != key:
                        yield from close()
                        key, rows = now, []
                    rows.append((left, right, node, home, label, members))
        yield from close()

    return join


def _blocks(members: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Every open member for each chunk of its region, every member for each block of open ones."""
    zero = F.lit(0).cast("long")
    sized = members.withColumn("open_", F.col("label") != F.col("core"))
    sized = sized.withColumn("blocks", F.ceil(F.greatest(F.col("open") / BLOCK, F.col("open_weight") / WEIGHT)).cast("long")).withColumn("chunks", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("weight") / WEIGHT)).cast("long"))
    one = (F.col("blocks") == 1) & (F.col("chunks") == 1)
    block, chunk = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks"))
    to_chunks = F.transform(F.sequence(zero, F.col("chunks") - 1), lambda c: F.struct(block.alias("block"), c.alias("chunk"), F.lit(True).alias("left"), F.lit(False).alias("right")))
    to_blocks = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), chunk.alias("chunk"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    alone = F.array(F.struct(zero.alias("block"), zero.alias("chunk"), F.col("open_").alias("left"), F.lit(True).alias("right")))
    to = F.when(one, alone).when(F.col("open_"), F.concat(to_chunks, to_blocks)).otherwise(to_blocks)
    placed = sized.where("open > 0").withColumn("to", F.explode(to)).select("region", "to.*", "node", "home", "label")
    return placed.join(texts, "node").repartition(n, "region", "block", "chunk").sortWithinPartitions("region", "block", "chunk")


def region_links(members: DataFrame, texts: DataFrame, words: int, percent: int, n: int) -> DataFrame:
    """Links (a, b) that connect the members (region, node, n_shingles, label) of each region as all links among them
    do, by texts (node, text); members with one label are connected already."""
    leaves, links, level = [], [], 0
    pending = materialize(members.select("region", "node", "n_shingles", F.lit(True).alias("home"), "label"))
    while True:
        sized = pending.join(_sized(pending), "region").where("open > 0")
        leaves.append(sized.where(F.col("size") <= LEAF))
        large = sized.where(F.col("size") > LEAF)
        if large.isEmpty():
            break
        parted = _part(large, texts, words, percent, level, n)
        links.append(parted.where("region is null").select(F.col("node").alias("a"), F.col("label").alias("b")))
        regions = parted.where("region is not null")
        less = _sized(regions, "parent").groupBy("parent").agg(F.sum("cost").alias("cost_left")).withColumnRenamed("parent", "region")
        better = materialize(large.select("region", "cost").distinct().join(less, "region").where("2 * cost_left <= cost").select("region"))
        leaves.append(large.join(better, "region", "left_anti"))
        pending = regions.join(better.withColumnRenamed("region", "parent"), "parent", "left_semi").drop("parent")
        level += 1
    joined = leaves[0]
    for x in leaves[1:]:
        joined = joined.unionByName(x)
    found = _blocks(joined, texts, n).mapInArrow(_join_blocks(words, percent), _LINKS)
    for x in links:
        found = found.unionByName(x)
    return found


def similarity_components(docs: DataFrame, words: int = WORDS, percent: int = THRESHOLD) -> DataFrame:
    """Rows (doc_id, row_key, n_shingles, component, component_id) for documents (doc_id, text).

    row_key tells rows of one id apart.  component is the least node of the component (null without shingles) and tells
    components apart, which component_id, a doc_id, does not where ids are null or repeated.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    sets = materialize(keyed.mapInArrow(_measure(words), "doc_id long, row_key long, n_shingles long, node long"))
    nodes = sets.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least_doc"), F.min("row_key").alias("row_key"), F.min("n_shingles").alias("n_shingles"))
    nodes = materialize(nodes)
    common = spark.sparkContext.broadcast(common_shingles(keyed, nodes, words))
    blocks = keyed.select("text").mapInArrow(_emit_keys(words, percent, 2 * n, common), "bucket int, kind int, nodes binary, times binary, high binary, low binary")
    groups = materialize(blocks.repartitionById(n, F.col("bucket") % n).mapInArrow(_groups, "a long, b long, times long"))
    shared = groups.where("times > 0").groupBy("a", "b").agg(F.sum("times").alias("times"))
    for side in ("a", "b"):
        shared = shared.join(nodes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}")), side)
    in_large = groups.where("times = 0").select(F.col("a").alias("key"), F.col("b").alias("node"))
    least = in_large.groupBy("key").agg(F.min("node").alias("region"))
    stars = materialize(in_large.join(least, "key").select("region", "node").distinct())
    spokes = stars.where("region <> node").select(F.col("region").alias("a"), F.col("node").alias("b"))
    pairs = materialize(shared.mapInArrow(_possible(percent), "a long, b long").unionByName(spokes))

    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "row_key"), "node"))
    texts = materialize(keyed.select("row_key", "text").join(_few(wanted), "row_key").dropDuplicates(["node"]).select("node", "text"))
    measured = _measured(pairs, texts, words)
    links = measured.where(F.expr(f"100 * both >= {percent} * either")).select("a", "b").distinct()
    if not stars.isEmpty():
        so_far = components(links)
        members = stars.join(so_far, "node", "left").withColumn("label", F.coalesce("component", "node")).select("region", "node", "label")
        open_ = members.groupBy("region").agg(F.min("label").alias("one"), F.max("label").alias("two")).where("one <> two").select("region")
        members = members.join(open_, "region").join(nodes.select("node", "n_shingles"), "node")
        links = links.unionByName(region_links(members, texts, words, percent, n))
    found = components(links)

    labelled = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    of_node = labelled.join(least, "component").select("node", "component", "component_id")
    own = sets.join(of_node, "node", "left")
    return own.select("doc_id", "row_key", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similarity_components(docs, words=3, percent=90).drop("row_key", "component")


#: Counts what all pairs of documents of like size share, so this is for small tables.
OP7_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), kinds AS (
    SELECT min(doc_id) AS kind, any_value(s) AS s, len(any_value(s)) AS n, list(doc_id) AS docs FROM sets GROUP BY list_sort(s), CASE WHEN len(s) = 0 THEN doc_id END
), members AS (
    SELECT kind, n, unnest(s) AS shingle FROM kinds
), links AS (
    SELECT a.kind AS a, b.kind AS b FROM members a JOIN members b ON a.shingle = b.shingle AND a.kind <> b.kind AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
    GROUP BY a.kind, b.kind, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(a, b) AS (
    SELECT kind, kind FROM kinds UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (
    SELECT a AS kind, min(b) AS component_id FROM reach GROUP BY a
)
SELECT unnest(docs) AS doc_id, n AS n_shingles, component_id FROM kinds JOIN least USING (kind)
"""
