"""Sampled segmentations over a SentencePiece vocabulary, and lossless decoding.

Spaces become the vocabulary's space mark.  No piece holds a mark after another character, so the lattice of a text falls
apart into the lattices of its units (a run of spaces and what follows up to the next one).  A unit's lattice has an edge for every
piece that it holds, and one of byte pieces for every character that is no piece (a literal space mark is none).
Forward filtering sums the weights of all ways to each place; backward sampling draws the last piece in proportion,
then the one before it, and so on.  The pieces of a BPE vocabulary come in the order of their merges and have no
probabilities, so a piece of rank r weighs (2 + r) ** -sharpness.

Draws are a hash of the row's key, the unit's place and the step, so a row has the same segmentation wherever and
whenever it is computed.  The distinct units of a batch are filtered side by side, and all units draw side by side.

Defined results: a null text is an empty one (no pieces); a null key counts as 0; texts are split as they are, with no
normalisation, so decoding gives back the very text; units of any length have one lattice; repeated rows get the same
segmentation; an empty table gives an empty result; further columns stay, but for pieces and decoded, which are replaced.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, slices

MARK = "▁"
SHARPNESS = 0.5
VOCABULARY = "piece_bpe_32k.model"
#: Stands in the table of pieces for what is no piece, but the beginning of one.
BEGINS = -2
_U = np.uint64
_BASE, _SLOTS = 0xC2B2AE3D27D4EB4F, 18
#: Weights are taken times this for each character, alike for all ways; every RESCALE characters the sums of a unit are
#: divided by the last one.  Both keep sums within floating-point range and change no share.
_PER_CHARACTER, RESCALE = 1e4, 32


def _prefix_sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(len(points) + 1, _BASE, np.uint64)
    down = np.full(len(points) + 1, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix64(points) * np.multiply.accumulate(up)[:-1], out=sums[1:])
    return sums, np.multiply.accumulate(down)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Vocabulary:
    def __init__(self, model_path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.bytes, self.spelled = np.zeros(256, np.int32), []
        number: dict[str, int] = {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.spelled.append(b"")
            else:
                self.spelled.append(piece.replace(MARK, " ").encode())
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"a piece with a space mark after other characters: {piece!r}")
                number[piece.replace(MARK, " ")] = i
        self.spelled_size = np.array([len(x) for x in self.spelled], np.int64)
        self.spelled_first = np.cumsum(self.spelled_size) - self.spelled_size
        self.letters = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.weight = (2.0 + np.arange(model.vocab_size())) ** -sharpness
        self.longest = max(map(len, number))
        number = {name[:k]: BEGINS for name in number for k in range(1, len(name))} | number
        names = list(number)
        sizes = np.array([len(x) for x in names])
        sums, down = _prefix_sums(_points("".join(names)))
        first = np.cumsum(sizes) - sizes
        keys = mix64((sums[first + sizes] - sums[first]) * down[first] + sizes.astype(np.uint64))
        self.keys, self.ids = np.zeros((1 << _SLOTS) + 64, np.uint64), np.full((1 << _SLOTS) + 64, -1, np.int32)
        for key, name in zip(keys.tolist(), names):
            at = key >> (64 - _SLOTS)
            while self.ids[at] != -1:
                at += 1
            self.keys[at], self.ids[at] = key, number[name]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each key, BEGINS where pieces only begin so, -1 where none does."""
        slot = (keys >> _U(64 - _SLOTS)).astype(np.int64)
        found = self.ids[slot]
        other = np.flatnonzero((self.keys[slot] != keys) & (found != -1))  # an empty slot ends a search
        while len(other):
            slot[other] += 1
            at = slot[other]
            found[other] = self.ids[at]
            other = other[(self.keys[at] != keys[other]) & (found[other] != -1)]
        return found

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of segmentations that stand in one array, from bounds[k] to bounds[k + 1]."""
        size = self.spelled_size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.spelled_first[ids] - ends[:-1], size) + np.arange(ends[-1])
        return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(ends[bounds].astype(np.int32)), pa.py_buffer(self.letters[at])])

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.spelled[i] for i in ids]).decode()


class Lattices:
    """The lattices of units: edges in the order of the node they end at, with shares that add up to 1 for each node."""

    def __init__(self, units: list[str], words: Vocabulary):
        points = _points("".join(units))
        self.size = np.array([len(u) for u in units], np.int64)
        first = np.cumsum(self.size) - self.size
        offset = np.arange(len(points)) - np.repeat(first, self.size)
        room = np.repeat(self.size, self.size) - offset
        sums, down = _prefix_sums(points)
        starts, lengths, ids, at = [], [], [], np.arange(len(points))
        for n in range(1, words.longest + 1):
            at = at[room[at] >= n]
            if not len(at):
                break
            found = words.find(mix64((sums[at + n] - sums[at]) * down[at] + _U(n)))
            here, at = at, at[found != -1]
            if n == 1:
                found = np.where(found < 0, -1 - points[here].astype(np.int64), found)
            hit = np.ones(len(here), bool) if n == 1 else found >= 0
            starts.append(here[hit])
            lengths.append(np.full(hit.sum(), n))
            ids.append(found[hit].astype(np.int64))
        start, length, ids = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, lengths, ids))
        weight = np.where(ids >= 0, words.weight[np.maximum(ids, 0)], words.weight[-1]) * (_PER_CHARACTER ** np.arange(words.longest + 1))[length]
        end = start + length - 1  # the character that an edge ends with stands for the node after it
        if len(points) * int(self.size.max(initial=0)) < 2**62 // (words.longest + 1):
            order = np.argsort((offset[end] * len(points) + end) * (words.longest + 1) + length)
        else:
            order = np.lexsort((length, end, offset[end]))
        start, length, end, self.ids, weight = start[order], length[order], end[order], ids[order], weight[order]
        self.length = length
        forward = np.zeros(len(points))
        share = np.empty(len(start))
        bounds = np.searchsorted(offset[end], np.arange(int(self.size.max(initial=0)) + 1))
        groups = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.empty(0, np.int64)
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            before = np.where(offset[start[a:z]] > 0, forward[start[a:z] - 1], 1.0)
            way = before * weight[a:z]
            own = groups[np.searchsorted(groups, a) : np.searchsorted(groups, z)] - a
            total = np.add.reduceat(way, own)
            forward[end[a:z][own]] = total
            share[a:z] = way / np.repeat(total, np.diff(np.append(own, z - a)))
            here = offset[end[a]] if z > a else 0
            if here and here % max(RESCALE, words.longest + 1) == 0:
                last = end[a:z][own]
                scale = forward[last].copy()
                for k in range(min(here, words.longest) + 1):
                    forward[last - k] /= scale
        self.until = np.cumsum(share)
        self.group_first = groups
        self.group_last = np.concatenate([groups[1:], [len(end)]]) - 1
        self.group_of = np.empty(len(points), np.int64)
        self.group_of[end[groups]] = np.arange(len(groups))
        self.first = first

    def draw(self, unit: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all units in order, and how many each has."""
        left, count, drawn = self.size[unit].copy(), np.zeros(len(unit), np.int64), []
        active = np.flatnonzero(left)
        step = 0
        while len(active):
            group = self.group_of[self.first[unit[active]] + left[active] - 1]
            chance = (mix64(seed[active] + _U(step)) >> _U(11)).astype(np.float64) * 2.0**-53
            edge = np.searchsorted(self.until, group + chance, side="right")
            edge = np.clip(edge, self.group_first[group], self.group_last[group])
            drawn.append((active, self.ids[edge]))
            left[active] -= self.length[edge]
            count[active] += 1
            active = active[left[active] > 0]
            step += 1
        end = np.cumsum(count)
        out = np.empty(int(end[-1]) if len(end) else 0, np.int64)
        for k, (own, ids) in enumerate(drawn):
            out[end[own] - 1 - k] = ids
        return out, count


_UNIT = re.compile(" *[^ ]+| +")


def segment(texts: list[str], keys: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of all texts in one array, and the pieces of each text."""
    index: dict[str, int] = defaultdict(itertools.count().__next__)
    of, number = [], []
    for text in texts:
        before = len(of)
        of.extend(map(index.__getitem__, _UNIT.findall(text)))
        number.append(len(of) - before)
    number = np.array(number, np.int64)
    unit = np.array(of, np.int64)
    place = np.arange(len(unit)) - np.repeat(np.cumsum(number) - number, number)
    seed = mix64(mix64(np.repeat(keys.astype(np.int64).view(np.uint64), number)) + place.astype(np.uint64))
    order = np.argsort(unit, kind="stable")  # draws of one unit stand together, which keeps its table in the cache
    drawn, count = Lattices(list(index), words).draw(unit[order], seed[order])
    sizes = np.empty(len(unit), np.int64)
    sizes[order] = count
    first = np.cumsum(sizes) - sizes
    at = np.repeat(first[order], count) + np.arange(len(drawn)) - np.repeat(np.cumsum(count) - count, count)
    ids = np.empty(len(drawn), np.int64)
    ids[at] = drawn
    text_of = np.repeat(np.repeat(np.arange(len(texts)), number), sizes)
    if (odd := np.flatnonzero(ids < 0)).size:
        spelled = [words.bytes[np.frombuffer(chr(-1 - i).encode(), np.uint8)] for i in ids[odd].tolist()]
        times = np.ones(len(ids), np.int64)
        times[odd] = [len(x) for x in spelled]
        byte = np.repeat(ids < 0, times)
        ids, text_of = np.repeat(ids, times), np.repeat(text_of, times)
        ids[byte] = np.concatenate(spelled)
    return ids.astype(np.int32), np.bincount(text_of, minlength=len(texts))


@lru_cache(2)
def _vocabulary(name: str, sharpness: float) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name), sharpness)


def encode(rows: DataFrame, key: str = "doc_id", text: str = "text", sharpness: float = SHARPNESS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds pieces (array of ids): a segmentation of ``text`` sampled with the seed ``key`` (an integer column)."""
    rows = rows.drop("pieces")
    schema = rows.select("*", F.array().cast("array<int>").alias("pieces")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(vocabulary, sharpness)
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                keys = np.array([k or 0 for k in part.column(key).to_pylist()], np.int64)
                ids, number = segment([t or "" for t in part.column(text).to_pylist()], keys, words)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(number)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds decoded: the text of the column pieces."""
    rows = rows.drop("decoded")
    schema = rows.select("*", F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(vocabulary, SHARPNESS)
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                pieces = part.column("pieces")
                bounds = pieces.offsets.to_numpy().astype(np.int64)
                ids = pieces.values.to_numpy()[bounds[0] : bounds[-1]]
                texts = words.decode_all(ids, bounds - bounds[0])
                texts.validate(full=True)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def op4_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decode(encode(docs))
    return found.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("lossless"))
