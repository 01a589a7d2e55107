"""Language ID by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled text.  Each line of a text is parsed greedily
into the longest strings that occur in the sample; the language that needs the fewest phrases for the text's letters
wins.  The lines of many texts step through their automata side by side; the counts of all lines of a text are added.

Letters are symbols of an alphabet without an "other letter": the FREQUENT letters of the samples are one symbol each,
every other letter is spelled by DIGITS digits of its code point after an escape, so no two letters are alike, however
many the scripts and languages have.  What a language's sample lacks begins a phrase, which the longest match after it
continues.

Only ``text`` and non-null ``lang`` of rows outside the held-out quarter are learned from.  The sample of a language is
bounded by SAMPLE_DOCS documents and SAMPLE_LETTERS characters: whole texts in the order of a hash of doc_id, those of up
to SAMPLE_TEXT characters first; where a language has longer ones only, WINDOWS windows spread over each of them.  The
rows of a language come to the driver until they hold that many characters.  Every text is then scored whole.

An automaton is a double array of its transitions, some 0.6 MB for a full sample.  Automata are sent to the workers in
groups of GROUP_BYTES; where languages need more than one group, texts pass the groups one after the other, with the
least counts so far written in between, so neither a worker's memory nor a broadcast grows with the languages.
More than MOST_LANGUAGES labels are refused: then ``lang`` is no language.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any labelled row every text
is ``und``; equal counts go to the language first in order; repeated rows are scored as often as they come; texts of any
length are parsed whole; an empty table gives an empty result; further columns stay, but for lang_pred and score, which
are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, released, slices

SAMPLE_DOCS, SAMPLE_LETTERS, SAMPLE_TEXT, WINDOWS = 64, 20_000, 2_500, 16
#: Letters with a symbol of their own, and the digits of base 2 ** BITS that spell others.
FREQUENT, DIGITS, BITS = 40, 4, 6
ESCAPE = FREQUENT + 1
#: Bytes of text that step through the automata side by side; bounds a task's memory only.
SLICE = 2 << 20
UNDETERMINED = "und"
#: A count that no text has.
NEVER = 2**62
#: Bytes of automata in a worker at once, and labels that a sample may have.
GROUP_BYTES, MOST_LANGUAGES = 64 << 20, 8192


def held_out() -> F.Column:
    """The quarter of the rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the root, every path from it spells a substring."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
        last = new
    return follow


def symbol_table(samples: dict[str, str]) -> np.ndarray:
    """Symbol of each code point: 0 no letter, 1 to FREQUENT the most frequent letters without case, otherwise ESCAPE plus
    the code point of the lower-case letter."""
    count = Counter(c for text in samples.values() for c in text.lower() if c.isalpha())
    number = {c: k + 1 for k, (c, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT])}
    table = np.zeros(0x110000, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = number.get(low, ESCAPE + ord(low[0]))
    return table


def symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All lines' symbols in one array, with runs of no-letters as one; first of each line and the end; the text of each
    line; letters of each text."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = table[points]
    letter = sym != 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    ends = np.flatnonzero(points == 10) + 1  # a text ends with a line end of its own
    text = np.searchsorted(np.cumsum(sizes), ends - 1, side="right")
    del points
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    letters = np.diff(np.concatenate([[0], np.cumsum(letter, dtype=np.int32)])[bounds])
    width = keep * np.where(sym >= ESCAPE, np.int8(1 + DIGITS), np.int8(1))
    first = np.concatenate([[0], np.cumsum(width, dtype=np.int32)])[np.concatenate([[0], ends])]
    sym, width = sym[keep], width[keep]
    if len(sym) and width.max() > 1:
        at = np.cumsum(width, dtype=np.int32) - width
        out = np.repeat(np.where(width > 1, ESCAPE, sym), width)
        odd = width > 1
        for k in range(DIGITS):
            out[at[odd] + 1 + k] = ESCAPE + 1 + ((sym[odd] - ESCAPE) >> (BITS * k) & ((1 << BITS) - 1))
        sym = out
    return sym.astype(np.uint8), first, text, letters


def double_array(follow: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(owner, target, root): a state is a place of its own, b; its transition by c is at b + c, where the owner is b.

    States with many transitions are placed first, each where its own places are free; those with one fill the gaps.
    """
    taken, used = bytearray(4 * len(follow) + 2 * width), bytearray(4 * len(follow) + 2 * width)
    place, start, several = [0] * len(follow), 0, True
    for s in sorted(range(len(follow)), key=lambda s: -len(follow[s])):
        marks = sorted(follow[s]) or [0]
        if several and len(marks) == 1:
            start, several = 0, False
        at, tries = taken.find(0, max(start, marks[0])), 0
        while True:
            if at < 0 or at + width >= len(taken):
                at = len(taken) if at < 0 else at
                taken.extend(bytes(len(taken)))
                used.extend(bytes(len(used)))
            b = at - marks[0]
            if not used[b] and not any(taken[b + c] for c in marks):
                break
            at, tries = taken.find(0, at + 1), tries + 1
        if tries > 32:
            start = at
        used[b] = 1
        place[s] = b
        for c in follow[s]:
            taken[b + c] = 1
    owner = np.full(max(place) + width, -1, np.int32)
    target = np.zeros(len(owner), np.int32)
    for s, edges in enumerate(follow):
        for c, z in edges.items():
            owner[place[s] + c], target[place[s] + c] = place[s], place[z]
    return owner, target, place[0]


class CrossParser:
    """The automata of some languages as one double array; ``restart`` has the state of each language after a phrase that
    begins with a symbol.  ``table`` has the symbols of all languages that are compared."""

    def __init__(self, samples: dict[str, str], table: np.ndarray | None = None):
        self.languages = sorted(samples)
        self.table = symbol_table(samples) if table is None else table
        width, base = ESCAPE + 1 + (1 << BITS), 0
        owners, targets, self.roots, restarts = [], [], [], []
        for name in self.languages:
            own, _, _, _ = symbols([samples[name]], self.table)
            owner, target, root = double_array(suffix_automaton(own.tolist()), width)
            here = slice(root, root + width)
            restarts.append(base + np.where(owner[here] == root, target[here], root))
            self.roots.append(base + root)
            owners.append(np.where(owner < 0, owner, owner + base))
            targets.append(target + base)
            base += len(owner)
        none = np.empty(0, np.int32)
        self.owner = np.concatenate(owners or [none]).astype(np.int32)
        self.target = np.concatenate(targets or [none]).astype(np.int32)
        self.restart = np.array(restarts, np.int32).reshape(len(self.languages), width)

    @property
    def size(self) -> int:
        return self.owner.nbytes + self.target.nbytes + self.restart.nbytes

    def phrases(self, sym: np.ndarray, first: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """Phrases of each text (column) by each language (row)."""
        start, size = first[:-1], np.diff(first)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        start, size, text = start[order], size[order], text[order]
        active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(size), axis=1)
        count = np.ones(state.shape, np.int32)
        for t, m in enumerate(active.tolist()):
            c = sym[start[:m] + t].astype(np.int32)
            now = state[:, :m]
            at = now + c
            hit = self.owner[at] == now
            if t:
                count[:, :m] += ~hit
            state[:, :m] = np.where(hit, self.target[at], self.restart[:, c])
        return np.stack([np.bincount(text, row, texts) for row in count]) if len(count) else np.empty((0, texts))


def sample(docs: DataFrame, docs_each: int = SAMPLE_DOCS, letters: int = SAMPLE_LETTERS) -> dict[str, str]:
    """Text of a few labelled documents a language; docs_each rows of a language at most reach the driver, none of them
    with more than ``letters`` characters."""
    labelled = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull() & ~held_out())
    n = F.char_length("text")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(n > SAMPLE_TEXT, F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")))
    spread = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.substring("text", (1 + F.floor((n - letters // WINDOWS) * k / (WINDOWS - 1))).cast("int"), F.lit(letters // WINDOWS)))
    body = F.when(n > letters, F.array_join(spread, "\n")).otherwise(F.col("text")).alias("body")
    drawn = labelled.select("lang", "doc_id", body, place.alias("place")).where(F.col("place") <= docs_each)
    ahead = F.coalesce(F.sum(F.char_length("body")).over(Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = drawn.withColumn("ahead", ahead).where(F.col("ahead") < letters)
    labels = labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if labels > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    rows = drawn.collect()
    texts: dict[str, list[str]] = {}
    held: Counter[str] = Counter()
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        if held[r["lang"]] < letters:
            texts.setdefault(r["lang"], []).append(r["body"])
            held[r["lang"]] += len(r["body"])
    return {k: "\n".join(v) for k, v in texts.items() if any(c.isalpha() for t in v for c in t)}


def parsers(samples: dict[str, str], most: int = GROUP_BYTES) -> Iterator[CrossParser]:
    """Parsers of groups of languages, in order, each of about ``most`` bytes (of one language at least)."""
    table = symbol_table(samples)
    whole = 32 * SAMPLE_LETTERS  # bytes of a full sample's automaton
    group: dict[str, str] = {}
    for name in sorted(samples):
        if group and (len(group) + 1) * whole > most:
            yield CrossParser(group, table)
            group = {}
        group[name] = samples[name]
    yield CrossParser(group, table)


def _scored(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """docs whose last three columns are the language with the least phrases so far and the two least counts; null at first."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    names = docs.columns
    at = range(len(names) - 3, len(names))

    @released
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        languages = np.array(model.languages, object)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = [t or "" for t in part.column("text").to_pylist()]
                sym, first, line_of, letters = symbols(texts, model.table)
                before = [np.array([NEVER if v is None else v for v in part.column(c).to_pylist()], np.int64) for c in at[1:]]
                best = np.array(part.column(at[0]).to_pylist(), object)
                need = model.phrases(sym, first, line_of, len(texts)).astype(np.int64)
                if len(need):
                    better = need.min(axis=0) < before[0]  # equal counts go to the earlier language
                    best = np.where(letters > 0, np.where(better, languages[need.argmin(axis=0)], best), None)
                two = np.sort(np.concatenate([need, before]), axis=0)[:2]
                new = {at[0]: pa.array(best, pa.string()), at[1]: pa.array(two[0], pa.int64()), at[2]: pa.array(two[1], pa.int64())}
                yield pa.RecordBatch.from_arrays([new.get(k, c) for k, c in enumerate(part.columns)], names=names)

    return docs.mapInArrow(score, docs.schema)


def identify(docs: DataFrame, groups: CrossParser | Iterable[CrossParser] | None = None) -> DataFrame:
    """All columns of docs with lang_pred and score, 1 - (phrases of the winner / phrases of the runner-up); by one parser, or
    by those of several groups of languages."""
    docs = docs.drop("lang_pred", "score")
    kept = docs.columns
    best, least, then = (f"{max(kept, key=len)}_{k}" for k in ("best", "least", "next"))  # longer than any name there is
    groups = parsers(sample(docs)) if groups is None else [groups] if isinstance(groups, CrossParser) else groups
    docs = docs.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in ((best, "string"), (least, "long"), (then, "long"))])
    for k, parser in enumerate(groups):
        docs = _scored(materialize(docs) if k else docs, parser)
    sure = F.when(F.col(then) == NEVER, 1.0).otherwise(1 - F.col(least) / F.col(then))
    return docs.select(*kept, F.coalesce(best, F.lit(UNDETERMINED)).alias("lang_pred"), F.when(F.col(best).isNull(), 0.0).otherwise(sure).alias("score"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), parsers(sample(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
