"""Near-duplicate documents by SimHash fingerprints and an exact Hamming join (generalised pigeonhole principle).

Fingerprints.  A bit is set if it is set in over half the 64-bit hashes (XXH64, seed 42) of a text's word shingles,
repeats included.  Equal fingerprints are one node from there on.

Join.  The 64 bits are dealt into m groups with thresholds t that add up to ``apart`` - m + 1 (-1: the group takes no
part), so two fingerprints at ``apart`` bits or fewer are within the threshold in at least one group.  Bits that go
together share a group, which leaves the groups unlike each other and so more selective.  m and the thresholds come from
dynamic programming over the estimated number of candidates of each group and threshold: every fingerprint is compared
with those of its batch, group by group.  Each fingerprint is then stored under its value in each group and probes all
values within the threshold; pairs that meet are verified on all 64 bits.

Large groups.  What meets under one value is linked as a tree, never as all pairs: small sets are measured at once and
reduced to a spanning forest, larger ones are searched breadth first, so that whoever is linked to what was found
before is not compared again with others found.  A value that holds over 1/HEAVY of all fingerprints (at most HEAVY
values a group) is parted again by the other bits, with thresholds of their own.

The driver receives a 64 x 64 table of bits, one histogram for each m, and the heavy values.

Defined results: documents without words, null ones among them, have fingerprint zero and are linked like any other;
with fewer words than a shingle has, the whole sequence is the one shingle; texts of any length are taken whole; repeated
rows and ids are rows like any others; component_id is the least id reachable, null ids come last (null where all are);
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bucket, materialize, mix64, partitions, slices
from .components import components
from .words import compact, parted_by, runs

PARTING = parted_by((0x20, 0x20), (0x09, 0x0D))
SEED = 42
APART = 4
#: Fingerprints that are compared with each other for the estimates.
BATCH = 128
#: A value is heavy from this share of all fingerprints on, and from this number.
HEAVY, HEAVY_LEAST = 4096, 4096
#: Cost of a stored or probed value (it is shuffled) in verified candidates.
PROBE_COST = 20
#: Sets with up to so many comparisons are measured at once; comparisons of one step.
SMALL, STEP = 1 << 17, 1 << 22
_ONE = np.uint64(1)


# ── fingerprints ─────────────────────────────────────────────────────────────────────────────────
def fingerprints_of(texts: list[str | None], words: int) -> np.ndarray:
    data, first, end, bounds = compact(texts, PARTING)
    start, each = runs(bounds, words)
    last = start + words - 1
    few = np.flatnonzero((each == 0) & (np.diff(bounds) > 0))  # one shingle: the whole sequence
    a, z = np.concatenate([first[start], first[bounds[few]]]), np.concatenate([end[last], end[bounds[few + 1] - 1]])
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[b:e], SEED) for b, e in zip(a.tolist(), z.tolist())), np.uint64, len(a))
    bits = np.zeros((len(texts), 64), np.int64)
    step, text = 1 << 16, np.repeat(np.arange(len(texts)), each)
    for k in range(0, len(text), step):  # shingles of one text are adjacent
        own = text[k : k + step]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        held = np.unpackbits(hashes[k : k + step].astype(">u8")[: len(own)].view(np.uint8).reshape(-1, 8), axis=1)
        bits[own[at]] += np.add.reduceat(held, at, axis=0, dtype=np.int64)
    out = np.packbits(2 * bits > each[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)
    out[few] = hashes[len(text) :]
    return out


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """Rows (doc_id, fingerprint as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                found = fingerprints_of(part.column("text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint long")


# ── plan ─────────────────────────────────────────────────────────────────────────────────────────
@dataclass(frozen=True)
class Layout:
    """Masks of the groups of bits and their thresholds."""

    masks: tuple[int, ...]
    limits: tuple[int, ...]


def _masks(table: np.ndarray, n: int, bits: list[int], m: int) -> tuple[int, ...]:
    """Deals bits into m groups of nearly equal size, each next one to where it is most correlated with the rest."""
    mean = np.diag(table) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    near = np.abs(table / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    left, groups = list(bits), []
    for g in range(m):
        own = [left.pop(0)]
        while len(own) < (len(bits) * (g + 1)) // m - (len(bits) * g) // m:
            own.append(left.pop(int(np.argmax(near[np.ix_(left, own)].sum(axis=1)))))
        groups.append(sum(1 << b for b in own))
    return tuple(groups)


def _bit_table(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """How many fingerprints have both bits set, for all pairs of bits, and how many fingerprints there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            held = ((x[:, None] >> np.arange(64, dtype=np.uint64)) & _ONE).astype(np.float32)
            total, n = total + (held.T @ held).astype(np.int64), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(total.ravel(), n))], names=["cell", "n"])

    rows = nodes.select("fingerprint").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097, np.int64)
    for r in rows:
        flat[r["cell"]] = r["n"]
    return flat[:4096].reshape(64, 64), int(flat[4096])


def _near_shares(nodes: DataFrame, masks: list[int], apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each mask and threshold 0 to ``apart``, pairs of one batch that are within it, and all pairs of batches."""
    width, mask = apart + 2, np.array(masks, np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pairs = np.zeros((len(mask), width), np.int64), 0
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(every), BATCH):
                x = every[k : k + BATCH]
                differ = x[:, None] ^ x[None, :]
                pairs += len(x) * (len(x) - 1)
                for i, m in enumerate(mask):
                    total[i] += np.bincount(np.minimum(np.bitwise_count(differ & m), width - 1).ravel(), minlength=width)
                    total[i, 0] -= len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size + 1)), pa.array(np.append(total.ravel(), pairs))], names=["cell", "n"])

    rows = nodes.select("fingerprint").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(len(mask) * width + 1, np.int64)
    for r in rows:
        flat[r["cell"]] = r["n"]
    return np.cumsum(flat[:-1].reshape(len(mask), width), axis=1)[:, :-1], flat[-1]


def allocate(costs: np.ndarray, apart: int) -> tuple[float, tuple[int, ...]]:
    """Least total cost, and thresholds from -1 on that add up to ``apart`` - groups + 1; costs[i, t + 1] is that of t."""
    m = len(costs)
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}  # by the sum of t + 1 so far
    for i in range(m):
        ahead: dict[int, tuple[float, tuple[int, ...]]] = {}
        for done, (cost, chosen) in best.items():
            for t in range(min(apart + 1 - done, costs.shape[1] - 1) + 1):
                now = (cost + costs[i, t], (*chosen, t - 1))
                if done + t not in ahead or now < ahead[done + t]:
                    ahead[done + t] = now
        best = ahead
    return best[apart + 1]


def plan(nodes: DataFrame, apart: int = APART) -> tuple[Layout, np.ndarray, int]:
    """The cheapest layout, the table of bits, and the number of fingerprints."""
    table, n = _bit_table(nodes)
    choices = {m: _masks(table, n, list(range(64)), m) for m in range(2, apart + 2)}
    within, pairs = _near_shares(nodes, [x for masks in choices.values() for x in masks], apart)
    at, found = 0, []
    for m, masks in choices.items():
        costs = np.zeros((m, apart + 2))
        for i, mask in enumerate(masks):
            for t in range(apart + 1):
                probes = sum(comb(mask.bit_count(), k) for k in range(t + 1))
                # the expected count also where no pair of a batch was that near: at least that of even bits
                share = max(within[at + i, t] / max(pairs, 1), probes / 2.0 ** mask.bit_count())
                costs[i, t + 1] = PROBE_COST * n * probes + n * n / 2 * share
        at += m
        cost, limits = allocate(costs, apart)
        found.append((cost, Layout(masks, limits)))
    return min(found, key=lambda x: x[0])[1], table, n


def _heavy(nodes: DataFrame, layout: Layout, n: int) -> dict[int, list[int]]:
    """Values of a group that over 1/HEAVY of all fingerprints have: at most HEAVY of each group."""
    least = max(HEAVY_LEAST, n // HEAVY)
    parts = [F.struct(F.lit(i).alias("part"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in enumerate(layout.masks) if layout.limits[i] >= 0]
    rows = nodes.select(F.explode(F.array(*parts)).alias("x")).groupBy("x.part", "x.value").count().where(F.col("count") > least).collect()
    found: dict[int, list[int]] = {}
    for r in rows:
        found.setdefault(r["part"], []).append(r["value"] & (2**64 - 1))
    return found


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


# ── join ─────────────────────────────────────────────────────────────────────────────────────────
def _masks_within(mask: int, limit: int) -> np.ndarray:
    """All sets of one to ``limit`` bits of a mask: what a probe flips."""
    bits, found, level = [b for b in range(64) if mask >> b & 1], [], [(0, 0)]
    for _ in range(limit):
        level = [(x | 1 << b, k + 1) for x, at in level for k, b in enumerate(bits) if k >= at]
        found += [x for x, _ in level]
    return np.array(found, np.uint64)


_MEET = np.dtype([("key", "<u8"), ("node", "<u8"), ("stored", "?")])


def _deal(buckets: int, layout: Layout, heavy: dict[int, list[int]], inner: dict[int, Layout]) -> Callable:
    """Sends every fingerprint to its values (stored) and to the values near them (probes), in blocks."""

    def keyed(x: np.ndarray, part: int, limit: int, mask: int, salt: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool, np.ndarray]]:
        """(keys, fingerprints, stored, values); equal keys mean equal salts, parts and values, up to 64-bit collisions."""
        own, code = x & np.uint64(mask), np.uint64((part + 1) * 0x9E3779B97F4A7C15 % 2**64)
        yield mix64(mix64(own ^ salt) + code), x, True, own
        for flip in _masks_within(mask, limit):
            yield mix64(mix64((own ^ flip) ^ salt) + code), x, False, own ^ flip

    def blocks(every: list[tuple[np.ndarray, np.ndarray, bool]]) -> Iterator[pa.RecordBatch]:
        out = np.empty(sum(len(k) for k, _, _ in every), _MEET)
        at = 0
        for key, node, stored in every:
            out["key"][at : at + len(key)], out["node"][at : at + len(key)], out["stored"][at : at + len(key)] = key, node, stored
            at += len(key)
        rows = [(b, out[own].tobytes()) for b, own in by_bucket(out["key"], buckets)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "block"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, every, held = batch.column(0).to_numpy().view(np.uint64), [], 0
            for part, (mask, limit) in enumerate(zip(layout.masks, layout.limits)):
                if limit < 0:
                    continue
                for key, node, stored, value in keyed(x, part, limit, mask, np.zeros(1, np.uint64)):
                    if part in heavy:
                        again = np.isin(value, np.array(heavy[part], np.uint64))
                        rest, code = node[again], mix64(value[again] + np.uint64(part + 101))
                        for k, (m, t) in enumerate(zip(inner[part].masks, inner[part].limits)):
                            if t < 0 or not len(rest):
                                continue
                            for deep, whose, own, _ in keyed(rest, 64 + k, t, m, code):
                                every.append((deep, whose, own and stored))  # what probed the heavy value only probes here
                        key, node = key[~again], node[~again]
                    every.append((key, node, stored))
                    held += len(key)
                    if held > STEP // 4:
                        yield from blocks(every)
                        every, held = [], 0
            yield from blocks(every)

    return deal


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) that connect the same nodes as a and b."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = flat[: len(a)], flat[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all():
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _breadth_first(stored: np.ndarray, probes: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over what is linked among stored fingerprints and between them and probes."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    open_ = np.ones(len(stored), bool)
    step = max(1, STEP // max(1, len(stored)))
    while open_.any():
        start = int(np.argmax(open_))
        open_[start] = False
        ahead = np.array([start])
        while len(ahead):
            now, ahead = ahead[:step], ahead[step:]
            left = np.flatnonzero(open_)
            near = np.bitwise_count(stored[now][:, None] ^ stored[left][None, :]) <= apart
            hit = near.any(axis=0)
            found.append((stored[now][near.argmax(axis=0)[hit]], stored[left[hit]]))
            open_[left[hit]] = False
            ahead = np.concatenate([ahead, left[hit]])
    step = max(1, STEP // len(stored))
    for k in range(0, len(probes), step):  # a probe may link several trees
        near = np.bitwise_count(probes[k : k + step][:, None] ^ stored[None, :]) <= apart
        p, s = np.nonzero(near)
        found.append(spanning(probes[k : k + step][p], stored[s]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _small_sets(node: np.ndarray, first: np.ndarray, mine: np.ndarray, size: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the stored fingerprints, which lead each set, with all of it; sets of all sizes at once."""
    stored = np.repeat(first, mine) + np.arange(mine.sum()) - np.repeat(np.cumsum(mine) - mine, mine)
    each = np.repeat(size, mine)
    a = np.repeat(stored, each)
    b = np.repeat(np.repeat(first, mine), each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    x, y = node[a], node[b]
    near = (np.bitwise_count(x ^ y) <= apart) & (x != y)
    return spanning(x[near], y[near])


def _meet(apart: int) -> Callable:
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [np.frombuffer(x, _MEET) for batch in batches for x in batch.column("block").to_pylist()]
        if not blocks:
            return
        every = np.concatenate(blocks)
        del blocks
        order = np.lexsort((~every["stored"], every["key"]))
        key, node, stored = every["key"][order], every["node"][order], every["stored"][order]
        del every, order
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff([*first, len(key)])
        mine = np.add.reduceat(stored, first, dtype=np.int64)
        some = (mine > 0) & (size > 1)
        first, size, mine = first[some], size[some], mine[some]
        links = []
        large = mine * size > SMALL
        for a, n, k in zip(first[large].tolist(), size[large].tolist(), mine[large].tolist()):
            links.append(_breadth_first(np.unique(node[a : a + k]), np.unique(node[a + k : a + n]), apart))
        first, size, mine = first[~large], size[~large], mine[~large]
        turn = np.cumsum(mine * size) // STEP
        for a, z in zip(at := np.searchsorted(turn, np.unique(turn)), [*at[1:], len(turn)]):
            links.append(_small_sets(node, first[a:z], mine[a:z], size[a:z], apart))
        if links:
            a, b = spanning(np.concatenate([x for x, _ in links]), np.concatenate([x for _, x in links]))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return meet


def hamming_links(nodes: DataFrame, apart: int = APART) -> DataFrame:
    """Links (a, b) that connect fingerprints (column fingerprint, distinct) exactly as all pairs at ``apart`` bits or fewer do."""
    layout, table, n = plan(nodes, apart)
    heavy = _heavy(nodes, layout, n)
    inner = {}
    for part in heavy:
        rest = [b for b in range(64) if not layout.masks[part] >> b & 1]
        m = max(1, (apart + 2) // 2)
        limits = Counter({k: 0 for k in range(m)})
        for k in range(apart - m + 1):
            limits[k % m] += 1
        inner[part] = Layout(_masks(table, n, rest, m), tuple(limits[k] for k in range(m)))
    buckets = 4 * partitions(nodes.sparkSession)
    dealt = nodes.select("fingerprint").mapInArrow(_deal(buckets, layout, heavy, inner), "bucket int, block binary")
    return dealt.repartition(buckets, "bucket").mapInArrow(_meet(apart), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, apart: int = APART) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id) of all documents."""
    found = materialize(fingerprints(docs, words))
    nodes = materialize(found.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    of = materialize(components(hamming_links(nodes, apart)))
    named = nodes.join(of, nodes["fingerprint"] == of["node"], "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(least, "component").select("fingerprint", "component_id")
    return found.join(known, "fingerprint").select("doc_id", "fingerprint", "component_id")


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
