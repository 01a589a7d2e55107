"""Importance resampling: CRC matrices, weights, Gumbel draw."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tidegrid.llm import resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " \n\t.", "A", "é! b-c", "x" * 2000, "one two " * 3000]


def lower(text):
    return (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def features(text, orders):
    w = WORD.findall(lower(text))
    return len(w), [b" ".join(w[i : i + n]) for n in range(1, orders + 1) for i in range(len(w) - n + 1)]


def brute(rows, goals, percent, orders, buckets, least, seed):
    own = [(i, *features(t, orders)) for i, t in rows]
    s, t = (Counter(zlib.crc32(f) % buckets for fs in many for f in fs) for many in ([fs for _, _, fs in own], [features(g, orders)[1] for g in goals]))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, n, fs in own:
        weight = sum(gain[zlib.crc32(f) % buckets] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, order[: percent * len(order) // 100]


def test_crc_matrices_equal_plain_crcs():
    rnd = random.Random(2)
    parts = [bytes(rnd.randrange(256) for _ in range(rnd.choice([1, 3, 8, 9, 17, 600]))) for _ in range(300)] * 2
    data, end = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    assert resampling.crcs(data, end - [len(p) for p in parts], end).tolist() == [zlib.crc32(p) for p in parts]


def test_draw_against_brute_force(spark):
    rnd = random.Random(4)
    pool = ["alpha", "Beta", "gamma9", "été", "k", "longer_word-with.marks", "ZZ"]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(rnd.choices(pool, k=rnd.randint(0, 40)))) for i in range(300)] + [(None, "alpha beta " * 12), (None, "k " * 30)]
    goals = [*ODD[:4], "alpha alpha beta", "été k k"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS n_features", "3 AS bucket", "4 AS row").repartition(5)
    target = spark.createDataFrame([(g,) for g in goals], "text string")
    for orders, buckets, percent in ((1, 10_000, 10), (2, 50, 33), (1, 7, 100)):
        got = [tuple(r) for r in resampling.resample(docs, target, percent, orders, buckets).collect()]
        want, drawn = brute(rows, goals, percent, orders, buckets, 20, 2024)
        assert sorted(str(r[:4]) for r in got) == sorted(str(r[:4]) for r in want)
        assert [r[:4] for r in sorted((r for r in got if r[4]), key=lambda r: r[4])] == [r[:4] for r in drawn]
        assert sorted(r[4] for r in got if r[4]) == list(range(1, len(drawn) + 1))


def test_ties_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(7, "w " * 25)] * 40 + [(None, "w " * 25)] * 20, "doc_id long, text string")
    none = docs.limit(0)
    got = resampling.resample(docs, none, 50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 31))
    assert resampling.resample(none, docs).count() == 0
    kept = resampling.resample(docs, docs, 10, keep=["text"]).where("rank is not null").collect()
    assert len(kept) == 6 and kept[0]["text"] == "w " * 25
