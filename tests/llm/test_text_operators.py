"""The text operators on small fixtures: brute force, exact round trips, held-out accuracy, and the odd cases."""

import copy
import hashlib
import itertools
import math
import os
import random
import re
import subprocess
import sys
import time
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import chats, common, components, fingerprints, jaccard_join, language_id, licences, masked_lm, neighbours, packing, sentencepiece_sampling, suffix_dedup

ODD = [None, "", " \n\t", "a", "A", "▁ bé \U0001f600", "word " * 3000]


def docs_of(spark, texts, extra=""):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.selectExpr("*", *[f"'x' AS {c}" for c in extra.split()])


def test_suffix_dedup_against_brute_force(spark):
    rnd = random.Random(5)
    pool = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(5, 60))) for _ in range(12)]
    texts = [*ODD[:-1], "ab" * 40, "x" * 90] + ["".join(rnd.choice([*pool, "".join(rnd.choice("defgh") for _ in range(9))]) for _ in range(rnd.randint(0, 9))) for _ in range(80)]
    length, raw = 20, [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for hot in (4096, 1):
        out = suffix_dedup.remove_repeats(docs_of(spark, texts, "kept n_bytes ranges row_key own spans marks"), length, 7, hot)
        got = {r.doc_id: r for r in out.collect()}
        for i, b in enumerate(raw):
            gone = bytearray(len(b))
            for k in range(len(b) - length + 1):
                if count[b[k : k + length]] > 1:
                    gone[k : k + length] = b"\1" * length
            assert bytes(got[i].kept) == bytes(x for x, y in zip(b, gone) if not y)
            assert len(got[i].spans) == len(re.findall(b"\1+", bytes(gone))) and got[i].n_bytes == len(b)
    assert suffix_dedup.remove_repeats(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_suffix_dedup_of_repeated_rows_and_long_texts(spark):
    rnd = random.Random(11)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(60_000))
    rows = [(None, "x" * 30), (None, long), (4, long[500:900]), (4, "unlike " + long[::-1][:300]), (5, "both " * 3), (5, "both " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ranges", F.lit(1))
    got = {(r.doc_id, r.text): bytes(r.kept) for r in suffix_dedup.remove_repeats(docs, 15, 5).collect()}
    assert got[None, long] == (long[:500] + long[900:]).encode() and got[4, long[500:900]] == b"" and got[None, "x" * 30] == b""
    assert got[4, "unlike " + long[::-1][:300]].decode() == "unlike " + long[::-1][:300] and got[5, "both " * 3] == b""


def test_suffix_dedup_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HELD", 64)
    test_suffix_dedup_against_brute_force(spark)


def test_suffix_dedup_sends_hot_windows_in_blocks():
    size, n = 30_000, 40
    marks = [[{"first": 0, "n": size - 199, "left": 0, "trigger": 1, "kind": 2}]] * n
    texts = ["".join(random.Random(i).choices("abcdefgh ", k=size)) for i in range(n)]
    batch = pa.RecordBatch.from_pydict({"row_key": list(range(n)), "text": texts, "marks": marks})
    sent = list(suffix_dedup._emit_bytes(200, 4)(iter([batch])))
    assert sum(len(x) for b in sent for x in b.column("head").to_pylist()) == n * (size - 199) * suffix_dedup._WINDOW.itemsize
    assert all(b.nbytes < 10 << 20 for b in sent)


KEPT = """
import random, re
import pyarrow as pa
from tidegrid.llm import suffix_dedup

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read()).group(1)) / 1024

def batch(seed):
    texts = ["".join(random.Random(seed * 5000 + i).choices("abcdefgh ", k=3000)) for i in range(4000)]
    return pa.RecordBatch.from_pydict({"row_key": list(range(4000)), "text": texts})

emit, start = suffix_dedup._emit_phrases(200, 64, 100), held()
for seed in range(2):
    assert sum(b.num_rows for b in emit(batch(seed) for _ in range(1))) >= 100
print(held() - start)
"""


def test_a_worker_gives_back_what_a_task_took():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    ran = subprocess.run([sys.executable, "-c", KEPT], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root})
    assert float(ran.stdout) < 50, ran.stderr


def _components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    of = {i: i for i in sets}
    for x, y in itertools.combinations(sorted(sets), 2):
        if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
            a, b = sorted((of[x], of[y]))
            of = {i: a if c == b else c for i, c in of.items()}
    return {i: (len(sets[i]), of[i]) for i in sets}


@pytest.mark.parametrize("words,percent,small", [(3, 90, 3), (2, 80, 24)])
def test_jaccard_join_against_brute_force(spark, monkeypatch, words, percent, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    for name, value in {"BLOCK": 7, "LEAF": 9, "PIVOTS": 4, "DEAL": 20, "SAMPLE": 64, "HELD_KEYS": 500, "HELD_PAIRS": 300}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rnd = random.Random(3)
    base = [[rnd.choice("abcdefghijklmnop") * rnd.randint(1, 2) for _ in range(rnd.randint(1, 90))] for _ in range(10)]
    texts = list(ODD)
    for _ in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(["zz", "q"])
        texts.append(rnd.choice([" ", "\t"]).join(w))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_components(docs_of(spark, texts, "node"), words, percent).collect()}
    assert got == _components(rows, words, percent)


@pytest.mark.parametrize("percent,leaf", [(90, 12), (80, 12), (60, 30), (80, 10_000)])
def test_voronoi_regions_keep_every_link(spark, monkeypatch, percent, leaf):
    """Clusters of near copies, of far ones and of a shared passage, joined by pivots, have the components of all pairs."""
    for name, value in {"BLOCK": 16, "LEAF": leaf, "PIVOTS": 5, "DEAL": 40}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rnd = random.Random(percent)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage, texts = [word() for _ in range(12)], []
    for _ in range(6):
        base = [word() for _ in range(40)]
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(40)] = word()
            texts.append(" ".join(w))
    texts += [" ".join([*passage, *(word() for _ in range(25))]) for _ in range(40)]
    sets = jaccard_join.shingle_sets(texts, 2)
    rows = [(k % 2, k, len(sets[k]), k, t) for k, t in enumerate(texts)]
    members = spark.createDataFrame(rows, "region long, node long, n_shingles long, label long, text string")
    found = components.components(jaccard_join.region_links(members.drop("text"), members.select("node", "text"), 2, percent, 4))
    got = {r.node: r.component for r in found.collect()}
    for half in (0, 1):
        want = _components([(k, t) for k, t in enumerate(texts) if k % 2 == half], 2, percent)
        assert {k: got.get(k, k) for k in want} == {k: c for k, (_, c) in want.items()}


def test_shared_members_of_all_sets():
    rng = np.random.default_rng(8)
    universe = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(rng.choice(universe[: rng.integers(5, 300)], rng.integers(0, 60))) for _ in range(90)] + [universe[:0]]
    sets += [np.sort(universe[100:200])] * 2 + [np.sort(universe[100:199])]
    want = [[len(np.intersect1d(x, y)) for y in sets[20:]] for x in sets[:60]]
    assert (jaccard_join._shared(sets[:60], sets[20:]) == want).all()
    assert jaccard_join._shared([], sets).shape == (0, 94) and jaccard_join._shared(sets[:1], sets[1:2]).shape == (1, 1)


def test_windows_of_the_triangle_inequality():
    """A linked pair is always in a region where one of the two is at home."""
    rng, r = np.random.default_rng(3), 0.2
    universe = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(universe[:60] if k % 2 else universe, rng.integers(5, 30))) for k in range(160)]
    sets += [np.unique(np.append(x[1:], universe[k])) for k, x in enumerate(sets)]
    chain = [universe[k : k + 60] for k in range(0, 120, 3)]  # neighbours differ by three of sixty
    sets += [np.sort(x) for x in chain]
    pivots = sets[::50] + [np.sort(x) for x in chain[::9]]
    elements = np.unique(np.concatenate(pivots))
    incidence = np.stack([np.isin(elements, p) for p in pivots], axis=1).astype(np.int32)
    placed = [jaccard_join.assign(x, elements, incidence, np.array([len(p) for p in pivots]), r) for x in sets]
    links = 0
    for (x, (home_x, in_x, _)), (y, (home_y, in_y, _)) in itertools.combinations(zip(sets, placed), 2):
        both = len(np.intersect1d(x, y))
        if both >= 0.8 * (len(x) + len(y) - both):
            links += 1
            assert home_x in in_y or home_y in in_x
    assert links > 50 and any(len(p[1]) > 1 for p in placed)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.similarity_components(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_packing_is_exact_and_gapless(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [*ODD, "  two  spaces \n x", "it's 12 o'clock!\n\n ", "<|endoftext|>", "b " * 700] + ["same words here"] * 40
    out = packing.pack(docs_of(spark, texts, "piece"), capacity=64, keep_ids=True, added=packing.ADDED).collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == ids
        assert all(r.length == 64 for r in own[1:]) and [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1])
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in own)
    used = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 64 and len(used) <= math.ceil(sum(used.values()) / 64) + 2
    assert packing.pack(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_packing_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c"), (None, "a b c"), (None, "x"), (7, "same"), (7, "other text"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("offset", F.lit(-1))
    out = packing.pack(df, capacity=4).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == {None: 3, 7: 3, 8: 1}
    used = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4


def test_plan_matches_best_fit_by_piece():
    rnd = random.Random(1)
    sizes = [rnd.choice([3, 5, 7, 20, 33, 50, 64]) for _ in range(400)]
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(64 - s)
    rows = packing.plan(dict(Counter(sizes)), 64)
    assert len({first + k for _, _, n, first, _ in rows for k in range(n)}) == len(rooms)


def test_language_id(spark):
    rnd = random.Random(2)
    kinds = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ür"], "cc": ["qui", "eau", "ére"]}
    rows = [(i, " ".join("".join(rnd.choices(kinds[k], k=3)) for _ in range(40)), k) for i, k in enumerate(rnd.choices(list(kinds), k=200))]
    odd = [(1000, None, "aa"), (1001, "12 !!", "bb"), (1002, "", None), (1003, "kato mika", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.CrossParser(language_id.sample(docs))).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == k for i, _, k in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and got[1003].lang_pred == "aa"
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_cross_parsing_against_a_plain_parser():
    """Greedy longest matches, line by line; letters beyond the frequent ones are told apart."""
    rnd = random.Random(9)
    samples = {"a": "".join(rnd.choice("abcd \u4e00\u4e01é") for _ in range(300)), "b": "".join(rnd.choice("abxy, \u4e02ß") for _ in range(300)), "c": "q"}
    parser = language_id.CrossParser(samples)

    def spelled(text):
        sym, first, _, _ = language_id.symbols([text], parser.table)
        return [bytes(sym[a:z]) for a, z in zip(first[:-1], first[1:])]

    known = {k: bytes(language_id.symbols([v], parser.table)[0]) for k, v in samples.items()}
    texts = ["", "a", "abab\nxyxy ab", "\u4e00\u4e02\u4e01", "".join(rnd.choice("abcdxyqz ,é\n\u4e00\u4e02\u4e03") for _ in range(400)), "\n\n", " ab"]
    sym, first, of, letters = language_id.symbols(texts, parser.table)
    got = parser.phrases(sym, first, of, len(texts))
    for i, text in enumerate(texts):
        for k, name in enumerate(parser.languages):
            want = 0
            for line in spelled(text):
                at = 0
                while at < len(line):
                    n = head = int(line[at : at + 1] not in known[name])
                    while at + n < len(line) and line[at + head : at + n + 1] in known[name]:
                        n += 1
                    at, want = at + n, want + 1
            assert got[k, i] == want, (text, name)
    assert letters.tolist() == [sum(c.isalpha() for c in t) for t in texts]


def test_languages_of_large_and_disjoint_alphabets(spark):
    rnd = random.Random(12)
    kinds = {"aa": range(0x4E00, 0x4EC8), "bb": range(0x4EC8, 0x4F90), "cc": range(0xAC00, 0xACC8)}
    rows = [(i, "".join(chr(rnd.choice(kinds[k])) for _ in range(60)), k) for i, k in enumerate(rnd.choices(list(kinds), k=240))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, language_id.CrossParser(language_id.sample(docs))).collect()}
    assert all(got[i] == k for i, _, k in rows if zlib.crc32(str(i).encode()) % 4 == 2)


def test_six_hundred_languages_in_groups(spark, monkeypatch):
    """Each language has two syllables of its own; automata in one group, in three and plain ones say the same."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rnd = random.Random(3)
    pairs = rnd.sample([x + y + z for x in letters for y in letters for z in letters], 1200)
    rows = [(2 * k + j, " ".join(rnd.choice(pairs[2 * k : 2 * k + 2]) for _ in range(30)), f"l{k:03}") for k in range(600) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language_id.sample(docs)
    assert len(samples) > 500
    whole = list(language_id.parsers(samples))
    some = list(language_id.parsers(samples, most=128 << 20))
    assert len(some) == 3 < len(whole) and sum(len(p.languages) for p in some) == len(samples) and all(p.size < 64 << 20 for p in whole)
    one = language_id.CrossParser(samples)
    got = [sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs, p).collect()) for p in (one, some)]
    assert got[0] == got[1]
    lang = {i: k for i, _, k in rows}
    assert all(p == lang[i] for i, p, _ in got[0] if lang[i] in samples)
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 100)
    with pytest.raises(ValueError, match="more than 100"):
        language_id.sample(docs)


def test_double_array_of_an_automaton():
    rnd = random.Random(4)
    for _ in range(20):
        follow = language_id.suffix_automaton([rnd.randrange(1, 106) if rnd.random() < 0.1 else rnd.randrange(1, 9) for _ in range(rnd.randrange(400))])
        owner, target, root = language_id.double_array(follow, 106)
        todo, place = [(0, root)], {}
        while todo:
            s, b = todo.pop()
            if place.setdefault(s, b) == b and len(place) <= len(follow):
                edges = {c: int(target[b + c]) for c in range(106) if owner[b + c] == b}
                assert edges.keys() == follow[s].keys()
                todo += [(follow[s][c], z) for c, z in edges.items() if follow[s][c] not in place]
        assert len(set(place.values())) == len(follow)


def test_language_id_of_long_texts_and_nothing(spark):
    long = ("kato mika tomi " * 2000, "schung ürsch ungür " * 2000)
    docs = spark.createDataFrame([(1, long[0], "aa"), (4, long[1], "bb"), (5, long[0] + "x" * 5000, None), (5, long[1], None), (5, long[1], None)], "doc_id long, text string, lang string")
    assert max(map(len, language_id.sample(docs).values())) <= language_id.SAMPLE_LETTERS + language_id.WINDOWS
    assert sorted(r.lang_pred for r in language_id.identify(docs).collect()) == ["aa", "aa", "bb", "bb", "bb"]
    assert language_id.identify(docs.limit(0)).count() == 0


def test_fingerprints(spark):
    texts = [*ODD, "one two\nthree", "one two\nthree"]
    rows = {r.doc_id: r for r in fingerprints.fingerprints(docs_of(spark, texts, "pieces")).collect()}
    assert rows[0].fingerprint == rows[1].fingerprint != rows[2].fingerprint and rows[7].fingerprint == rows[8].fingerprint
    following = {r.doc_id: r.next_text for r in fingerprints.with_next(docs_of(spark, texts), "text").collect()}
    assert following == {i: texts[(i + 1) % len(texts)] for i in range(len(texts))}
    x = F.array(*map(F.lit, [2, 2, 4])).cast("array<bigint>")
    y = F.array(*map(F.lit, [2, 6])).cast("array<bigint>")
    assert spark.range(1).select(fingerprints.likeness(x, y).alias("v")).first().v == 2 * 1 / 5
    assert fingerprints.with_next(docs_of(spark, ["x"]).limit(0), "text").count() == 0


def test_pieces_follow_the_content(spark):
    rnd = random.Random(22)
    words = ["".join(rnd.choice("abdemorst") for _ in range(rnd.randint(1, 8))) for _ in range(400)]
    line = " ".join(words)
    edits = [line, "put " + line, " ".join([*words[:200], "between", *words[200:]]), " ".join(words[3:]), " ".join(w[::-1] + "q" for w in words)]
    texts = [*ODD, "m" * 300_000, "ab " * 40, " lead\n\n trail \n", "Ωμν да нет\tжук", *edits]
    cut = fingerprints.pieces(F.col("text"))
    joined = F.regexp_extract_all("text", F.lit(fingerprints._PIECES % 15), F.lit(0)).alias("parts")
    rows = {r.doc_id: r for r in docs_of(spark, texts).withColumn("base", F.lit(line)).select("doc_id", joined, fingerprints.likeness(fingerprints.pieces(F.col("base")), cut).alias("like")).collect()}
    for i, t in enumerate(texts):
        parts = rows[i].parts or []
        assert "".join(parts) == (t or "") and all(len(x.split()) <= 16 for x in parts)
        for x in parts:  # words within a piece do not end one
            assert all(w[-1] not in ".!?mMμмմםمम" for w in re.findall(r"[^ \t\n\x0B\f\r]+", x)[:-1])
    one, put, between, less, other = (rows[len(texts) - 5 + k].like for k in range(5))
    assert one == 1 and put > 0.9 and between > 0.9 and less > 0.9 and other < 0.05


def test_trees_compute_each_operand_once(spark):
    """An operand named within a lambda would be computed again for each paragraph, so a text of n lines n * n digests."""
    assert str(fingerprints.sections(F.col("operand"))).count("operand") == 1
    columns = ("mine", "my_digests", "others", "their_digests")
    found = str(fingerprints.differing(*map(F.col, columns)))
    assert found.count("others") == 1 and found.count("mine") == 1
    lines = [f"line {i} of a long text" for i in range(3000)]
    row = fingerprints.with_tree(docs_of(spark, ["\n".join(lines)]), "text").first()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    own, sections = [digest(x) for x in lines], [[]]
    for i, d in enumerate(own):
        sections[-1].append(d)
        if int(d[:2], 16) % fingerprints.SECTION == 0 and i + 1 < len(own):
            sections.append([])
    assert row.sections == sections and row.section_digests == [digest("".join(x)) for x in sections]
    assert row.fingerprint == digest("".join(row.section_digests))


def test_differing_branches_locate_edits(spark):
    rnd = random.Random(21)
    lines = ["".join(rnd.choice("abcdef ") for _ in range(30)) for _ in range(60)]
    changed = [*lines[:37], "another line", *lines[38:]]
    inserted = [*lines[:20], "a new line", *lines[20:]]
    texts = ["\n".join(x) for x in (changed, inserted, lines, lines[:-5])]
    docs = docs_of(spark, texts).withColumn("other", F.lit("\n".join(lines)))
    trees = fingerprints.with_tree(fingerprints.with_tree(docs, "text"), "other", "other_")
    branches = fingerprints.differing(*(F.col(c) for c in ("sections", "section_digests", "other_sections", "other_section_digests")))
    got = {r.doc_id: r for r in trees.withColumn("branches", branches).collect()}
    place = lambda r, b: sum(len(s) for s in r.sections[: b.section]) + b.paragraph
    assert [[place(got[i], b) for b in got[i].branches] for i in range(4)] == [[37], [20], [], []]
    assert got[2].fingerprint == got[2].other_fingerprint != got[3].fingerprint
    same = [len(set(got[i].section_digests) & set(got[i].other_section_digests)) for i in range(3)]
    assert same[2] - same[1] <= 2 and same[2] - same[0] <= 2 and same[2] > 4


def test_fingerprints_of_null_and_repeated_ids(spark):
    rows = [(None, "a"), (None, None), (3, "x " * 5000), (3, "b"), (1, "q"), (3, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("stay", F.lit("clash"))
    got = [(r.doc_id, r.text, r.next_text) for r in fingerprints.with_next(fingerprints.fingerprints(docs), "text").collect()]
    order = [(None, ""), (None, "a"), (1, "q"), (3, "b"), (3, "b"), (3, "x " * 5000)]
    assert sorted(got, key=str) == sorted([(*x, order[(k + 1) % 6][1]) for k, x in enumerate(order)], key=str)


def test_sampled_segmentations(spark):
    import public_tokenizers

    out = sentencepiece_sampling.decode(sentencepiece_sampling.encode(docs_of(spark, [*ODD, "hello there world"], "decoded"))).collect()
    assert all(r.decoded == (r.text or "") for r in out)
    again = sentencepiece_sampling.encode(docs_of(spark, [*ODD, "hello there world"]).repartition(1)).collect()
    assert {r.doc_id: r.pieces for r in out} == {r.doc_id: r.pieces for r in again}
    words = sentencepiece_sampling.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    number = {words.spelled[i].decode(): i for i in words.ids[words.ids >= 0].tolist()}

    def ways(s):
        return [((), 1.0)] if not s else [((number[s[:k]], *rest), words.weight[number[s[:k]]] * w) for k in range(1, len(s) + 1) if s[:k] in number for rest, w in ways(s[k:])]

    for text in ("there", "    if"):  # runs of spaces have pieces too
        want = dict(ways(text))
        ids, sizes = sentencepiece_sampling.segment([text] * 20_000, np.arange(20_000), words)
        got = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(sizes)[:-1]))
        total = sum(want.values())
        for way, w in want.items():
            assert abs(got[way] / 20_000 - w / total) < 5 * math.sqrt(w / total / 20_000) + 1e-3


def test_long_units_have_one_lattice(spark, monkeypatch):
    """Shares of the last pieces do not depend on how often sums are scaled, and pieces span every place."""
    import public_tokenizers

    words = sentencepiece_sampling.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    shares = []
    assert words.longest < 24
    for step in (24, 32):  # more than the longest piece
        monkeypatch.setattr(sentencepiece_sampling, "RESCALE", step)
        shares.append(sentencepiece_sampling.Lattices(["the" * 20, "internationalization" * 4, "a"], words).until)
    assert np.allclose(*shares)
    text = "there" * 4000 + "x" * 3000
    ids, sizes = sentencepiece_sampling.segment([text] * 3, np.arange(3), words)
    crossed = set()
    for own in np.split(ids, np.cumsum(sizes)[:-1]):
        assert words.decode(own.tolist()) == text
        crossed |= set(range(len(text))) - set(np.cumsum([len(words.spelled[i]) for i in own.tolist()]).tolist())
    assert len(crossed) > 0.9 * len(text) and crossed & {64 * k for k in range(1, 300)}


def test_sampled_segmentations_of_odd_rows(spark):
    rows = [(None, "the same text"), (None, "the same text"), (0, "the same text"), (5, "the same text"), (5, "the same text")]
    got = [(r.doc_id, tuple(r.pieces)) for r in sentencepiece_sampling.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len({p for i, p in got if i in (None, 0)}) == 1 and len({p for i, p in got if i == 5}) == 1 and len(got) == 5
    assert sentencepiece_sampling.decode(sentencepiece_sampling.encode(docs_of(spark, ["x"]).limit(0))).count() == 0


def _naive_scores(texts, frequent, rare, share, network):
    """Every token by the definition: class by the network, word by its count elsewhere."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    count = Counter(w for t in split for w in t)
    key = {w: int(masked_lm.word_hashes([w])[0][0]) >> 16 for w in count}
    enough = [w for w in count if count[w] >= 2 * max(2.0, share * sum(count.values()))]
    top = sorted(enough, key=lambda w: (-count[w], key[w]))[:frequent]
    mixed = {w: int(masked_lm.mix64(np.array([key[w]], np.uint64))[0]) for w in count}
    class_of = {w: top.index(w) if w in top else frequent + mixed[w] % rare for w in count}
    total, distinct = Counter(class_of[w] for t in split for w in t), Counter(class_of.values())
    out = []
    for t in split:
        ids = [class_of[w] for w in t]
        padded = [network.classes] * 2 + ids + [network.classes] * 2
        score = 0.0
        for k, w in enumerate(t):
            h = np.tanh(network.c + sum(network.embed[j][padded[k + d]] for j, d in enumerate((0, 1, 3, 4))))
            z = (h @ network.w + network.b).astype(float)
            score += z[ids[k]] - z.max() - np.log(np.exp(z - z.max()).sum())
            if ids[k] >= frequent:
                score += math.log(count[w] - 1 + masked_lm.ALPHA) - math.log(total[ids[k]] - 1 + masked_lm.ALPHA * distinct[ids[k]])
        out.append((len(t), score))
    return out


def test_masked_lm_against_the_definition(spark, monkeypatch):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    texts = [" ".join(rnd.choice(["the", "of", rnd.choice(words)]) for _ in range(rnd.randint(1, 50))) for _ in range(60)]
    texts += [texts[3], texts[3], *ODD]
    docs = docs_of(spark, texts, "log_prob row_key classes own")
    networks, train = [], masked_lm.train
    monkeypatch.setattr(masked_lm, "train", lambda *a, **k: networks.append(train(*a, **k)) or networks[-1])
    rows = masked_lm.masked_scores(docs, frequent=4, rare=3, share=1 / 128, shard=700).collect()
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(texts) == len(rows) and rows[0].row_key == rows[0].classes == "x"
    for i, (n, score) in enumerate(_naive_scores(texts, 4, 3, 1 / 128, networks[0])):
        assert got[i].n_tokens == n and got[i].log_prob == pytest.approx(score, rel=1e-4, abs=1e-4)
        assert got[i].mean_log_prob == (pytest.approx(got[i].log_prob / n) if n else None)
    assert masked_lm.masked_scores(docs.limit(0)).count() == 0


def test_hot_words_are_counted_apart_from_words_with_like_hashes(spark):
    words = [f"w{k}" for k in range(3000)]
    of = {}
    for w in words:
        of.setdefault(int(masked_lm.word_hashes([w])[0][0]) >> 48, []).append(w)
    often, once = next(v for v in of.values() if len(v) > 1)[:2]  # the upper 16 bits are alike
    texts = [f"{often} {w}" for w in words if w not in (often, once)] + [once]
    docs = docs_of(spark, texts)
    known = masked_lm.hot_words(docs, 1, 2, 1 / 64)
    assert len(known.hot) == 1 and known.tokens == 2 * 2998 + 1
    got = {r.doc_id: r.log_prob for r in masked_lm.masked_scores(docs, frequent=0, rare=2, share=1 / 64, epochs=0).collect()}
    network = masked_lm.Network(2)
    want = _naive_scores(texts, 0, 2, 1 / 64, network)
    assert all(got[i] == pytest.approx(score, rel=1e-4) for i, (_, score) in enumerate(want))


def test_hot_words_reach_their_bound_in_any_chunks(spark, monkeypatch):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["a", "b" * rnd.randint(1, 9), f"c{rnd.randrange(4000)}"]) for _ in range(200)) for _ in range(60)]
    count, share = Counter(w for t in texts for w in t.split()), 1 / 50
    for chunk in (50, 1 << 21):
        monkeypatch.setattr(masked_lm, "CHUNK_TOKENS", chunk)
        known = masked_lm.hot_words(docs_of(spark, texts), share=share)
        hot = {w for w in count if known.place(masked_lm.word_hashes([w])[0] >> np.uint64(16))[0] >= 0}
        assert {w for w in count if count[w] >= 2 * share * known.tokens} <= hot and len(hot) == len(known.hot) <= 50
        assert known.tokens == sum(count.values()) and min(count[w] for w in hot) >= share * known.tokens


def test_masked_lm_does_not_depend_on_partitions(spark):
    rnd = random.Random(14)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(3)) for _ in range(300)]
    texts = [" ".join(rnd.choice(["the", "of", "and", rnd.choice(words)]) for _ in range(rnd.randint(1, 200))) for _ in range(200)]
    scores = []
    for n in (2, 8):
        out = masked_lm.masked_scores(docs_of(spark, texts).repartition(n, "doc_id"), frequent=6, rare=4, shard=4000)
        scores.append({r.doc_id: r.log_prob for r in out.collect()})
    assert all(scores[0][i] == pytest.approx(scores[1][i], abs=1e-6) for i in scores[0])


def test_gradients_of_the_network():
    rng = np.random.default_rng(2)
    network = masked_lm.Network(7, 2, 3, rng.normal(0, 0.5, 4 * 8 * 3 + 3 + 3 * 7 + 7))
    ids, sizes = rng.integers(0, 7, 40).astype(np.uint8), np.array([15, 0, 25])
    around = network.contexts(ids, sizes)
    assert around[:, 15].tolist() == [7, 7, ids[16], ids[17]] and around[:, 14].tolist() == [ids[12], ids[13], 7, 7]
    grads = np.concatenate([g.ravel() for g in network.gradients(ids, around)])
    for k in rng.choice(len(network.values), 40, replace=False):
        loss = []
        for step in (1e-5, -1e-5):
            network.values[k] += step
            loss.append(-network.log_probs(ids, around).mean())
            network.values[k] -= step
        assert grads[k] == pytest.approx((loss[0] - loss[1]) / 2e-5, abs=1e-6)


def test_training_learns_contexts_and_copies_stand_out(spark):
    rnd = random.Random(15)
    texts = [" ".join(rnd.choice(["a b c d", "x y z w"]) for _ in range(60)) for _ in range(40)]
    strange = lambda: " ".join("".join(rnd.choice("efgh") for _ in range(8)) for _ in range(30))
    once, twice = strange(), strange()
    docs = docs_of(spark, [*texts, once, twice, twice])
    trained, flat = ({r.doc_id: r for r in masked_lm.masked_scores(docs, frequent=8, rare=4, epochs=e).collect()} for e in (3, 0))
    assert sum(trained[i].log_prob for i in range(40)) > 0.8 * sum(flat[i].log_prob for i in range(40))
    assert trained[41].mean_log_prob > trained[40].mean_log_prob + 1 and trained[41].log_prob == trained[42].log_prob


def test_nearest_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 16))
    x[:300] = x[0] + 0.01 * rng.standard_normal((300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0]), (2004, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "vector": F.lit("clash"), "half": F.lit(None), "query_id": F.lit(0)})
    got = neighbours.nearest(df, F.col("id") % 50 == 0, 5).collect()
    y = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 1500, 50):
        s = y[q] @ y.T
        s[q] = -2
        best = set(np.argsort(-s)[:5].tolist())
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(abs(r.score - s[r.id]) < 1e-12 for r in own)
        hit += len(best & {r.id for r in own})
    assert hit >= 0.9 * 150 and not {r.query_id for r in got} & {2000}
    few = neighbours.nearest(df.where("vec_id in (0, 400, 401)"), F.col("id") % 50 == 0, 5).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2), (400, 1), (400, 2)]


def test_nearest_of_outliers_and_copies(spark):
    """Every query has its k rows: two vectors far from all others, and many copies of one vector, repeated ids, ties."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16)) * 0.05 + 1
    x[0], x[1500] = -1 + 0.01 * x[0], -1 + 0.01 * x[1500]
    x[200:900] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, (2 * x[0]).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("id") % 50 == 0, 5).collect()
    own = {q: [(r.id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in range(0, 3000, 50)}
    assert all(len(v) == 5 and q not in dict(v) for q, v in own.items())
    assert {i for i, _ in own[0]} > {50, 1500}  # the least vector of the repeated id counts
    assert [i for i, _ in own[200]] == [201, 202, 203, 204, 205] and [i for i, _ in own[850]] == [200, 201, 202, 203, 204]
    assert neighbours.nearest(df.limit(0), F.col("id") % 50 == 0, 5).count() == 0


def test_licences(spark):
    known = dict(licences.known_texts())
    mit, apache = known["MIT"], known["Apache-2.0"]
    one_line = mit.replace("\n", " ")
    texts = [
        *ODD[:-1], "Copyright (c) 2020 Somebody\nAll rights reserved.\n" + mit.upper().replace(" ", "\n  "), mit + " more", "text\nLicenced under the Apache Licence, version 2.0!\nmore",
        f"before\n{one_line}\nafter", apache.replace("\n", "\r\n"), "word " * 50_000 + one_line, "x " * 100_000, known["GPL-3"],
    ]
    docs = docs_of(spark, texts, "digest license")
    got = {r.doc_id: r for r in licences.scan_licenses(docs, licences.known_digests(spark)).collect()}
    assert got[6].license == "MIT" and got[7].license is None and got[0].digest is None and got[1].digest is None
    assert got[8].line_licenses == ["Apache-2.0-notice"] and got[8].license is None and got[3].digest == got[4].digest
    assert len(one_line) > 400 and got[9].line_licenses == ["MIT"] and got[10].license == "Apache-2.0" and got[13].license == "GPL-3"
    assert got[11].license is None and got[11].line_licenses == [] and got[12].digest is not None
    twice = licences.known_digests(spark, [("one", mit), ("two", mit.upper()), ("nothing", "...")])
    assert [r.license for r in licences.scan_licenses(docs.where("doc_id = 6"), twice).collect()] == ["one|two"]
    assert licences.scan_licenses(docs.limit(0), twice).count() == 0
    plain = "nothing of the kind"
    rows = spark.createDataFrame([(None, mit), (None, mit), (None, plain), (1, None), (1, "Released under the MIT License."), (1, plain)], "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.license, r.line_licenses) for r in licences.scan_licenses(rows, licences.known_digests(spark)).collect()), key=str)
    assert [x[:2] for x in got] == [("1", "MIT-notice"), ("1", None), ("1", None), ("None", "MIT"), ("None", "MIT"), ("None", None)]
    assert [x[2] for x in got if x[1] is None] == [[], [], []] and all(x[2] == ["MIT-notice"] for x in got if x[1] == "MIT-notice")  # licences stay with their row


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "yo"), (4, 0, "user", "yo"), (5, 0, None, None), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("h", F.lit("clash"))
    got = {r.conv_id: r for r in chats.render(df).collect()}
    assert set(got) == {1, 4, 5} and got[1].n_copies == 2 and got[1].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert got[4].n_turns == 1 and chats.render(df.limit(0)).count() == 0


def test_chats_with_one_number_for_several_turns(spark, tmp_path):
    """Turns with equal and null numbers, as the SQL orders them."""
    import duckdb

    rnd = random.Random(31)
    rows = [(c, rnd.choice([None, 0, 0, 1]), rnd.choice(["user", "bot", None]), rnd.choice(["hi", "yo", "x\ny", ""])) for c in range(40) for _ in range(rnd.randint(1, 6))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in chats.op6_chat_formatting(spark, str(tmp_path)).select("conv_id", "n_turns", "n_copies", "rendered").collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert got == sorted(db.sql(chats.OP6_SQL).fetchall()) and len(got) > 10


def test_jaccard_join_of_repeated_rows_and_ids(spark):
    long = " ".join(f"w{k}" for k in range(4000))
    rows = [(None, "a b c d"), (None, "a b c d"), (None, "q r s t u"), (5, long), (5, long + " x"), (9, "a b c d"), (9, None), (2, "q r s t u"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"component": F.lit("clash"), "bucket": F.lit(0)})
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similarity_components(docs, 3, 90).collect())
    assert got == Counter({(None, 2, 9): 2, (9, 2, 9): 1, (9, 0, 9): 1, (None, 3, 2): 1, (2, 3, 2): 1, (2, 0, 2): 1, (5, 3998, 5): 1, (5, 3999, 5): 1})


def test_nothing_through_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "some words to keep", "en", "s", 18), (2, "some words to keep", "en", "s", 18), (None, "other words to keep", "en", None, None)]
    docs = spark.createDataFrame(rows, kinds).withColumn("score", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(r.text for r in docs.collect()) == ["other words to keep", "some words to keep"]


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = text(60)
    texts = [text(80) for _ in range(30)]
    texts += [texts[0], texts[1] + " x", f"{text(40)}\n{passage}\n{text(40)}", f"{text(40)}\n{passage}\n{text(40)}", "123 456", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == {*range(30), 32, 33} and all(kept[i] == texts[i] for i in range(30))
    assert all(passage[10:-10] not in kept[i] for i in (32, 33))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept)


def test_blocks_are_compared_in_bounded_memory(monkeypatch):
    rnd = np.random.default_rng(9)
    pool = rnd.integers(0, 2**64, 200_000, dtype=np.uint64)
    one, two = ([np.unique(rnd.choice(pool, 600)) for _ in range(1000)] for _ in range(2))
    tracemalloc.start()
    both = jaccard_join._shared(one, two)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20  # 74 MB with all 1.2 million members in order at once
    assert all(both[a, b] == len(np.intersect1d(one[a], two[b])) for a, b in zip(range(0, 1000, 7), range(999, 0, -7)))
    for held in (7, 50, 5000):  # few members at a time, and members of many sets
        monkeypatch.setattr(jaccard_join, "HELD_MEMBERS", held)
        monkeypatch.setattr(jaccard_join, "STRIP", 5)
        one, two = ([np.unique(rnd.choice(pool[:60], rnd.integers(0, 40))) for _ in range(n)] for n in (33, 29))
        assert jaccard_join._shared(one, two).tolist() == [[len(np.intersect1d(x, y)) for y in two] for x in one]
    assert jaccard_join._shared([], two).shape == (0, 29) and not jaccard_join._shared([np.empty(0, np.uint64)], [np.empty(0, np.uint64)]).any()


def test_search_for_a_piece_ends_at_an_empty_slot():
    class Counted:
        def __init__(self, values):
            self.values, self.read = values, 0

        def __getitem__(self, at):
            self.read += len(at)
            return self.values[at]

    words = copy.copy(sentencepiece_sampling._vocabulary(sentencepiece_sampling.VOCABULARY, 0.5))
    used = np.flatnonzero(words.ids >= 0)
    assert (words.find(words.keys[used]) == words.ids[used]).all()
    words.keys = Counted(words.keys)
    assert (words.find(np.random.default_rng(5).integers(0, 2**64, 10_000, dtype=np.uint64)) < 0).all()
    assert words.keys.read < 20_000 and len(words.find(np.empty(0, np.uint64))) == 0


def test_near_duplicates_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    rnd = random.Random(8)
    texts = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(40)) for _ in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1] + " x"), (7, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[4] + " x"), (None, texts[5]), (3, texts[5]), (3, texts[5]), (1, texts[6])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text.removesuffix(" x")) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[4]), (3, texts[5]), (1, texts[6])], key=str)


def test_packing_knows_added_tokens(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x\n", "no <|endoftext| > here", "<|END|>  of  text", None]
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: zlib.crc32(np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in enumerate(texts)}
    assert model.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for packed in (packing.op9_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, str(tmp_path))):
        assert {r.doc_id: r.ids_crc32 for r in packed.collect()} == want


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages by plain loops: documents with letters, one of each component, windows that occur once, whole pieces."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    rnd = random.Random(17)
    words = ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(3, 8))) for _ in range(600)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [text(70) for _ in range(3)]
    texts = [text(rnd.randint(1, 120)) for _ in range(40)]
    texts += [t + rnd.choice(["", " x", " one more"]) for t in rnd.choices(texts, k=15)]
    texts += [f"{text(rnd.randint(0, 60))}\n{rnd.choice(passages)}\n{text(rnd.randint(0, 60))}" for _ in range(12)]
    texts += [*passages[:1], "1 2 3", "", None, text(1500), "<|endoftext|> " + text(30)]
    rows = [(i, t, rnd.choice(["en", None]), "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    kept = {i: t for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")}
    component = {i: c for i, (_, c) in _components(list(kept.items()), 5, 80).items()}
    kept = {i: t for i, t in kept.items() if component[i] == i}
    raw = {i: t.encode() for i, t in kept.items()}
    count = Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    for i, b in raw.items():
        gone = {j for k in range(len(b) - 199) if count[b[k : k + 200]] > 1 for j in range(k, k + 200)}
        runs = itertools.groupby(range(len(b)), lambda j: j in gone)
        kept[i] = "".join(b[own[0] : own[-1] + 1].decode(errors="ignore") for cut, js in runs if not cut for own in [list(js)])
    kept = {i: t for i, t in kept.items() if t}
    assert len(kept) < len(raw) < len(texts) and any(kept[i].encode() != raw[i] for i in kept)
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*model.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in kept.items()}
    want = {}
    for i, x in ids.items():
        cuts = [len(x) % 2048] * bool(len(x) % 2048) + [2048] * (len(x) // 2048)
        for k, (a, n) in enumerate(zip(np.cumsum([0, *cuts]), cuts)):
            want[i, k] = (a, n, zlib.crc32(x[a : a + n].tobytes()))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
    used = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    rooms = []
    for n in sorted((x[1] for x in want.values()), reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 2048) - n)
    assert max(used.values()) <= 2048 and len(used) == len(rooms)


def _grouped(parts, common=None):
    """Pairs and large groups of batches of texts, as candidates for 5 words and 80 percent."""
    shared = SimpleNamespace(value=np.empty(0, jaccard_join._COMMON) if common is None else common)
    emit = jaccard_join._emit_keys(5, 80, 4, shared)
    blocks = [x for part in parts for x in emit(iter([pa.RecordBatch.from_arrays([pa.array(part)], names=["text"])]))]
    pairs, large = set(), {}
    for a, b, times in (row for x in jaccard_join._groups(iter(blocks)) for row in zip(*(c.to_pylist() for c in x.columns))):
        if times:
            pairs.add((a, b))
        else:
            large.setdefault(a, set()).add(b)
    return pairs, large


def test_groups_of_shared_passages_hold_no_unrelated_documents(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(6))
    passages = [[word() for _ in range(150)] for _ in range(2)]
    texts = [" ".join([*passages[k % 2], *(word() for _ in range(150))]) for k in range(80)]
    node = [jaccard_join.set_digest(x) for x in jaccard_join.shingle_sets(texts, 5)]
    keyed = spark.createDataFrame([(k, t, n) for k, (t, n) in enumerate(zip(texts, node))], "row_key long, text string, node long")
    common = jaccard_join.common_shingles(keyed.select("row_key", "text"), keyed.select("row_key", "node"), 5)
    pairs, large = _grouped([texts], common)
    passage = {n: k % 2 for k, n in enumerate(node)}
    assert all(len({passage[n] for n in group}) == 1 for group in [*pairs, *large.values()])


def test_linked_sets_share_enough_classes():
    """Whatever part of the shingles is common, and whatever the counts."""
    rng = np.random.default_rng(5)
    levels, shingles = jaccard_join.Levels(80), lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    for _ in range(300):
        n = int(rng.integers(1, 700))
        both = shingles(n)
        few = both[: int(rng.integers(0, n + 1))]
        common = np.empty(len(few), jaccard_join._COMMON)
        common["shingle"], common["times"] = few, rng.integers(3, 9, len(few))
        common.sort(order="shingle")
        x, y = both, np.concatenate([both[int(rng.integers(0, n // 10 + 1)) :], shingles(int(rng.integers(0, n // 10 + 1)))])
        if 100 * len(np.intersect1d(x, y)) < 80 * len(np.union1d(x, y)):
            continue
        keys = [jaccard_join.class_keys(np.unique(s), levels, common) for s in (x, y)]
        times = len(np.intersect1d(*keys))
        assert times and levels.possible(np.array([len(x)]), np.array([len(y)]), np.array([times])).all()


def test_copies_in_other_batches_make_no_large_group():
    rnd = random.Random(2)
    base = [rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(120)]
    texts = [" ".join([*base[:k], "zz", *base[k + 1 :]]) for k in (10, 50, 90)]
    pairs, large = _grouped([texts] * 30)
    assert not large and len(pairs) == 3


def test_a_large_group_of_one_batch_is_whole():
    rnd = random.Random(3)
    base = [rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(200)]
    pairs, large = _grouped([[" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(40)]])
    assert large and all(len(group) > jaccard_join.SMALL for group in large.values())


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: set(re.findall(r"shuffle_\w+\.data", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    table = common.materialize(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(10):  # not longer: the driver's garbage goes some time anyway
        if left := files() - before:
            time.sleep(0.02)
    assert not left and spark.conf.get(key) == "false" and len(table.collect()) == 7
