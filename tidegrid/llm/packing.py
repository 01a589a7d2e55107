"""Best-fit packing of tokenised documents into fixed-length sequences, planned on the histogram of lengths.

The plan needs only how many pieces there are of each length (at most ``capacity`` numbers, whatever the corpus
holds).  Best-fit decreasing runs over those counts: a step places all pieces of one length that meet the same kind
of open sequence at once.  Its rows say "pieces of length l with ranks from lo on go to sequences from s on, at
offset o"; pieces take their slots by joining on rank within length.

Defined results: a null text is an empty one (its only token is the closing id 0), rows of a null or repeated doc_id are
packed as often as they come, a text of any length is cut into as many pieces as it takes, pieces of equal length are
placed in the order of doc_id, piece and checksum within their part, an empty table gives an empty result, further
columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, released, slices

CAPACITY = 2048
END_ID = 0
#: The tokenizer whose added tokens the queries know.
ADDED = "byte_bpe_50k.json"
#: Words whose ids a worker remembers; beyond it the memory is emptied, which costs time only.
CACHE_WORDS = 400_000
#: Rows of the plan that are broadcast; a longer plan is joined without a hint.  A plan has a few rows for each length.
MOST_SLOTS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CachedTokenizer:
    """Byte-level BPE ids of whole texts, from units that are remembered.

    The vocabulary's pattern starts a new unit at every space that is followed by something else than white space,
    so ids of "word" and " word" can be kept and put together.  Other texts are encoded as a whole.  The ids are those
    that ``tokenizers`` gives with byte_bpe_50k.json and add_special_tokens=False; the ranks file holds the same
    vocabulary and is read faster.  Tests hold one against the other.  With ``added_path``, the json, texts that hold
    one of its added tokens go through ``tokenizers``; without, such strings are ordinary text.
    """

    _open = re.compile(r" (?:\s|\Z)")

    def __init__(self, ranks_path: str, added_path: str | None = None):
        import tiktoken
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(added_path) if added_path else None
        self._added = [t.content for t in self._whole.get_added_tokens_decoder().values()] if self._whole else []

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._encode = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if any(t in text for t in self._added):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self._open.search(text):
            return np.array(self._encode(text), "<u4").tobytes()
        if len(self._known) > CACHE_WORDS:
            self._known = {}
        known, (first, *rest) = self._known, text.split(" ")
        parts = [known.get(w) for w in rest]
        if None in parts:
            for i, part in enumerate(parts):
                if part is None:
                    parts[i] = known[rest[i]] = np.array(self._encode(" " + rest[i]), "<u4").tobytes()
        return np.array(self._encode(first), "<u4").tobytes() + b"".join(parts)


@lru_cache(1)
def _tokenizer(name: str, added: str | None) -> CachedTokenizer:
    import public_tokenizers

    return CachedTokenizer(public_tokenizers.path(name), public_tokenizers.path(added) if added else None)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.tiktoken", keep_ids: bool = False, added: str | None = None) -> DataFrame:
    """One row per piece of a document (doc_id, text): piece, start, length, CRC-32 of the ids, and the ids if asked."""

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _tokenizer(vocabulary, added).encode, np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rows: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = encode(text or "") + end
                    n = len(ids) // 4
                    start = 0
                    for k, length in enumerate(([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append((doc_id, k, start, length, zlib.crc32(own), own if keep_ids else None))
                        start += length
                if rows:
                    doc_ids, k, start, length, crc, own = zip(*rows)
                    columns = [pa.array(doc_ids, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + ", ids binary" * keep_ids)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, pieces, first sequence, offset).

    A piece goes to the open sequence with the least room that still holds it; all sequences with the same room are
    alike, so whole ranges of them are filled at once.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges (first sequence, sequences)
    order: list[int] = []  # the keys of room, ascending
    opened = 0

    def leave(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                bisect.insort(order, free)
                room[free] = []
            room[free].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                free = order[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free], order[at]
                take = min(n, left)
                rows.append((length, rank, take, first, capacity - free))
                leave(free, first + take, n - take)
                leave(free - length, first, take)
                left, rank = left - take, rank + take
                continue
            each = min(capacity // length, left)
            bins = left // each
            for slot in range(each):
                rows.append((length, rank, bins, opened, slot * length))
                rank += bins
            leave(capacity - each * length, opened, bins)
            opened, left = opened + bins, left - each * bins
    return rows


def _ranked(pieces: DataFrame) -> DataFrame:
    """Adds the rank (from 0) of each piece among those of its length, without gathering a length in one task: ranks are
    counted in parts, four for each shuffle partition."""
    parts = 4 * partitions(pieces.sparkSession)
    parted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.groupBy("length", "part").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return parted.withColumn("within", within).join(counts.drop("n"), ["length", "part"]).withColumn("rank", F.col("within") + F.col("ahead")).drop("part", "within", "ahead")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.tiktoken", keep_ids: bool = False, added: str | None = None) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; offsets of a sequence are gapless from 0."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, capacity, vocabulary, keep_ids, added))
    counted = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    rows = plan({r["length"]: r["n"] for r in counted}, capacity)
    slots = spark.createDataFrame(rows, "length long, first_rank long, places long, first_sequence long, offset long")
    slots = F.broadcast(slots) if len(rows) <= MOST_SLOTS else slots
    ranked = _ranked(pieces)
    fits = (ranked["length"] == slots["length"]) & (ranked["rank"] >= slots["first_rank"]) & (ranked["rank"] < slots["first_rank"] + slots["places"])
    placed = ranked.join(slots, fits).withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank"))
    return placed.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", *["ids"] * keep_ids, "sequence_id", "offset")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), added=ADDED)
