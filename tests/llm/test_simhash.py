"""SimHash fingerprints and the exact Hamming join against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidegrid.llm import simhash
from tidegrid.llm.components import components


def fingerprint(text, words=4):
    raw = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    parts = [b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, apart=4):
    """Least of the values reachable from each, over all pairs."""
    x = np.array(values, np.uint64)
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= apart)
    root = np.arange(len(x))
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        root = root[root]
        if (root == before).all():
            return root


def test_fingerprints_and_components_of_documents(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \n", "A", "a", "a b", "é b\tc", "X y Z", "x y z w"]
    for _ in range(8):
        base = [word() for _ in range(300)]
        for _ in range(12):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(300)] = word()
            texts.append(rnd.choice([" ", "\n "]).join(w))
    texts.append(" ".join(word() for _ in range(90_000)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (3, "A"), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fingerprint", "2 AS least", "3 AS component").repartition(4)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"] & (2**64 - 1), r["component_id"] if r["component_id"] is not None else -1) for r in simhash.near_duplicates(docs).collect())
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    prints = [fingerprint(rows[k][1]) for k in order]
    root = classes(prints)
    want = sorted((rows[k][0] is None, rows[k][0] or 0, p, -1 if rows[order[r]][0] is None else rows[order[r]][0]) for k, p, r in zip(order, prints, root))
    assert got == want and len({w[3] for w in want}) > 8
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("small,heavy,choose", [(1 << 17, 4096, None), (8, 6, None), (64, 6, ((20, 22, 22), (0, 1, 1))), (64, 40, ((32, 32), (2, 1))), (64, 6, ((16, 16, 16, 16), (2, -1, 0, 0)))])
def test_every_layout_keeps_every_link(spark, monkeypatch, small, heavy, choose):
    """Scattered fingerprints, tight balls, and fingerprints that share the low half; all ways of parting and searching."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "HEAVY_LEAST", heavy)
    rnd = random.Random(small + heavy)
    values = {rnd.getrandbits(64) for _ in range(150)}
    for _ in range(4):
        centre = rnd.getrandbits(64)
        values |= {centre ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 6))) & (2**64 - 1) for _ in range(60)}
    low = rnd.getrandbits(32)
    values |= {low | rnd.getrandbits(32) << 32 for _ in range(80)} | {low ^ 1 << rnd.randrange(32) | (rnd.getrandbits(12) << 40) for _ in range(150)}
    values = sorted(values)
    if choose:
        sizes, limits = choose
        bits = list(range(64))
        rnd.shuffle(bits)
        masks = [sum(1 << bits.pop() for _ in range(n)) for n in sizes]
        real = simhash.plan
        monkeypatch.setattr(simhash, "plan", lambda nodes, apart: (simhash.Layout(tuple(masks), limits), *real(nodes, apart)[1:]))
    nodes = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fingerprint long").repartition(3)
    found = {r.node & (2**64 - 1): r.component for r in components(simhash.hamming_links(nodes)).collect()}
    groups = {}
    for v, r in zip(values, classes(values)):
        groups.setdefault(r, set()).add(v)
    mine = {}
    for v in values:
        mine.setdefault(found.get(v, ("alone", v)), set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_thresholds_are_the_cheapest():
    rnd = np.random.default_rng(3)
    for m in (1, 2, 3, 5):
        costs = np.concatenate([np.zeros((m, 1)), np.cumsum(rnd.random((m, 5)) * rnd.integers(1, 100, (m, 1)), axis=1)], axis=1)
        every = [t for t in np.ndindex(*[6] * m) if sum(t) == 5]
        cost, limits = simhash.allocate(costs, 4)
        assert sum(limits) == 4 - m + 1
        assert cost == pytest.approx(min(sum(costs[i, k] for i, k in enumerate(t)) for t in every))


def test_links_of_a_large_ball_are_a_forest(spark):
    """2,000 fingerprints within a few bits of each other give fewer links than twice their number, not two million."""
    rnd = random.Random(9)
    values = {sum(1 << rnd.randrange(64) for _ in range(2)) & (2**64 - 1) for _ in range(4000)}
    nodes = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fingerprint long").repartition(2)
    links = simhash.hamming_links(nodes)
    assert links.count() <= 20 * len(values)
    assert components(links).select("component").distinct().count() == 1
    assert components(links).select(F.count_distinct("node")).first()[0] == len(values)
