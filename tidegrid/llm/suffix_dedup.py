"""Exact removal of byte strings that occur more than once, by prefix-free parsing.

A rolling hash over TRIGGER bytes marks, for each window of ``length`` bytes, the trigger with the least hash inside
it.  Windows with the same trigger form a phrase; phrases overlap by ``length`` - 1 bytes, so every window lies in one
phrase, and equal windows have equal triggers at equal places, wherever they occur.  From there:

1. Dictionary.  Phrases go in blocks to the bucket of their trigger's hash.  A trigger that occurs once ends the matter
   for its windows; a phrase that occurs as a whole more than once repeats in all its windows.
2. Parse order.  Of triggers with several phrases, one copy of each phrase goes to the trigger's bucket with its bytes.
   There the suffixes that begin at triggers are sorted (a suffix array with common prefix lengths), and phrase
   suffixes left of the trigger are classed by a hash for each length.  A window repeats if its part right of the
   trigger stands in one interval of the order with another phrase whose left part is in the same class.
3. Of a trigger with more than HOT phrases no bytes are gathered: its windows meet by digest, dealt over all buckets.

Whatever repeats within one batch is known to repeat: it is marked at once, and one copy goes on to the bucket, so that
a bucket receives a frequent string once from each batch.

Ranges found go back to their documents, whose bytes are cut.  Results are exact up to collisions of 64-bit hashes
between strings that share a trigger.

Defined results: documents are told apart by their row, so repeated rows count as repeats of each other; null texts are
empty; texts below ``length`` bytes are kept whole, longer ones of any length are searched whole; an empty table gives an
empty result; further columns stay, but for n_bytes, spans, kept and kept_text, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HASH_SLICE, by_bucket, materialize, mix64, partitions, released, slices

LENGTH = 200
TRIGGER = 64
HOT = 1024
#: Bytes of phrases and windows that a task gathers before it sends them.
HELD = 8 << 20
BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_TABLE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
MARKS = "row_key long, first int, n int, kind int, trigger long, left int"
RANGES = "row_key long, first int, n int"
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, HASH_SLICE + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            values = np.full(size, base, np.uint64)
            values[0] = 1
            _powers[name] = np.multiply.accumulate(values)
    return _powers["up"][:n], _powers["down"][:n]


class Rolling:
    """Hashes of any substring of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[:-1], out=self.sums[1:])

    def each(self, width: int) -> np.ndarray:
        return (self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width]

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[first]) * self.down[first]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array; first of each text and the end."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), bounds


def phrases(texts: list[bytes], length: int, trigger: int) -> dict[str, np.ndarray]:
    """Columns text, first (window, in its text), n (windows), left (bytes before the trigger), trigger, phrase (hashes)."""
    data, bounds = joined(texts)
    sizes = np.diff(bounds)
    windows = np.maximum(0, sizes - length + 1)
    if not windows.sum():
        return {k: np.empty(0, np.int64) for k in ("text", "first", "n", "left")} | {k: np.empty(0, np.uint64) for k in ("trigger", "phrase")}
    rolling = Rolling(data)
    grams = mix64(rolling.each(trigger))
    bits = _U(max(20, int(len(data)).bit_length()))
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    span, width = length - trigger + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    text = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + bounds[:-1][text]
    q = (least[at] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (text[1:] != text[:-1])]))
    n = np.diff(np.concatenate([new, [len(q)]]))
    lo, q, text = at[new], q[new], text[new]
    whole = mix64(rolling.of(lo, lo + n - 1 + length) + (q - lo).astype(np.uint64) * _U(0xD6E8FEB86659FD93) + n.astype(np.uint64))
    return {"text": text, "first": lo - bounds[:-1][text], "n": n, "left": q - lo, "trigger": grams[q], "phrase": whole}


def _rows(fields: list[tuple[str, pa.DataType, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for _, t, v in fields], names=[n for n, _, _ in fields])


_PHRASE = np.dtype([("trigger", "<u8"), ("phrase", "<u8"), ("row_key", "<i8"), ("first", "<i4"), ("n", "<u2"), ("left", "<u2"), ("again", "?")])


def _first_of_each(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by keys (the last counts first), where new ones begin in it, and how often each comes."""
    order = np.lexsort(keys)
    new = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)])
    return order, new, np.bincount(np.cumsum(new) - 1)


def _emit_phrases(length: int, trigger: int, buckets: int) -> Callable:
    def close(blocks: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(blocks)
        blocks.clear()
        order, new, times = _first_of_each(every["phrase"], every["trigger"])
        every = every[order]
        every["again"] = (times > 1)[np.cumsum(new) - 1]
        out = []
        for known, chosen, key in ((False, new, "trigger"), (True, ~new, "row_key")):
            own = every[chosen]
            out += [(b, known, own[at].tobytes()) for b, at in by_bucket(own[key].view(np.uint64), buckets)]
        return _rows([(name, kind, [x[k] for x in out]) for k, (name, kind) in enumerate((("bucket", pa.int32()), ("known", pa.bool_()), ("block", pa.binary())))])

    @released
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = []
            for part in slices(batch, "text", HASH_SLICE):
                found = phrases([(t or "").encode() for t in part.column("text").to_pylist()], length, trigger)
                own = np.empty(len(found["n"]), _PHRASE)
                for k in ("trigger", "phrase", "first", "n", "left"):
                    own[k] = found[k]
                own["row_key"] = part.column("row_key").to_numpy()[found["text"]]
                if len(own):
                    blocks.append(own)
            if blocks:
                yield close(blocks)

    return emit


def _dictionary(hot: int) -> Callable:
    """Marks of a bucket: kind 0 repeats as a whole, 1 one copy of a phrase to compare, 2 the same of a hot trigger."""

    def marks(x: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        if len(x):
            yield _rows([("row_key", pa.int64(), x["row_key"]), ("first", pa.int32(), x["first"]), ("n", pa.int32(), x["n"].astype(np.int32)), ("kind", pa.int32(), np.full(len(x), kind, np.int32)), ("trigger", pa.int64(), x["trigger"].view(np.int64)), ("left", pa.int32(), x["left"].astype(np.int32))])

    @released
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[int, list[bytes]] = {}  # one bucket at a time
        for batch in batches:
            for bucket, known, x in zip(*(batch.column(k).to_pylist() for k in ("bucket", "known", "block"))):
                if known:
                    yield from marks(np.frombuffer(x, _PHRASE), 0)
                else:
                    packed.setdefault(bucket, []).append(x)
        while packed:
            every = np.frombuffer(b"".join(packed.popitem()[1]), _PHRASE)
            order, new, times = _first_of_each(every["phrase"], every["trigger"])
            every = every[order]
            phrase = np.cumsum(new) - 1
            group = np.concatenate([[0], np.cumsum(every["trigger"][1:] != every["trigger"][:-1])])
            kinds = np.bincount(group, new)[group]
            yield from marks(every[every["again"] | (times > 1)[phrase]], 0)
            yield from marks(every[new & (kinds > 1) & (kinds <= hot)], 1)
            yield from marks(every[new & (kinds > hot)], 2)

    return decide


def _marked(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[dict]]]:
    for part in slices(batch, "text", 1 << 20):
        for key, text, marks in zip(part.column("row_key").to_pylist(), part.column("text").to_pylist(), part.column("marks").to_pylist()):
            yield key, (text or "").encode(), marks


_HEAD = np.dtype([("row_key", "<i8"), ("first", "<i4"), ("n", "<u2"), ("left", "<u2"), ("size", "<u2")])
_WINDOW = np.dtype([("digest", "<u8"), ("row_key", "<i8"), ("first", "<i4"), ("again", "?")])


def _emit_bytes(length: int, buckets: int) -> Callable:
    """Marked phrases with their bytes, in blocks for the bucket of their trigger; windows of hot triggers by digest."""

    @released
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, texts, triggers, held, windows = [], [], [], 0, []
            for key, text, marks in _marked(batch):
                hot = [m for m in marks if m["kind"] == 2]
                for m in marks:
                    if m["kind"] == 1:
                        own = text[m["first"] : m["first"] + m["n"] - 1 + length]
                        heads.append((key, m["first"], m["n"], m["left"], len(own)))
                        texts.append(own)
                        triggers.append(m["trigger"])
                        held += len(own)
                if hot:
                    digest = mix64(Rolling(np.frombuffer(text, np.uint8)).each(length))
                    at = np.unique(np.concatenate([np.arange(m["first"], m["first"] + m["n"]) for m in hot]))
                    own = np.zeros(len(at), _WINDOW)
                    own["digest"], own["row_key"], own["first"] = digest[at], key, at
                    windows.append(own)
                    held += own.nbytes
                if held > HELD:
                    yield from closed(heads, texts, triggers, windows)
                    held = 0
            yield from closed(heads, texts, triggers, windows)

    def closed(heads: list, texts: list, triggers: list, windows: list) -> Iterator[pa.RecordBatch]:
        if heads:
            head = np.array(heads, _HEAD)
            keys = np.array(triggers, np.int64).view(np.uint64)
            yield rows([(b, 0, head[at].tobytes(), b"".join(texts[i] for i in at)) for b, at in by_bucket(keys, buckets)])
        if windows:
            every = np.concatenate(windows)
            order, new, times = _first_of_each(every["digest"])
            every = every[order]
            every["again"] = (times > 1)[np.cumsum(new) - 1]
            one, rest = every[new], every[~new]
            out = [(b, 1, one[at].tobytes()) for b, at in by_bucket(one["digest"], buckets)]
            yield rows(out + [(b, 2, rest[at].tobytes()) for b, at in by_bucket(rest["row_key"].view(np.uint64), buckets)])
        for x in (heads, texts, triggers, windows):
            x.clear()

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = [[x[k] if k < len(x) else b"" for x in out] for k in range(4)]
        return _rows(list(zip(("bucket", "kind", "head", "bytes"), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), columns)))

    return emit


def repeated_windows(texts: np.ndarray, begin: np.ndarray, left: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Which windows of phrases occur in two phrases.  Phrase k begins at texts[begin[k]], its trigger ``left`` bytes later.

    Result [k, a]: the window that begins a bytes before the trigger of k (False where k has none).
    """
    m = len(begin)
    reach = int(left.max()) + 1
    right_size = left * 0 + length - (left - (n - 1))  # bytes from the trigger to the end of the last window
    columns = np.arange(length)
    padded = np.concatenate([texts, np.zeros(length, np.uint8)])
    right = padded[(begin + left)[:, None] + columns]
    right[columns >= right_size[:, None]] = 0
    order = np.argsort(right.view(f"S{length}").ravel(), kind="stable")
    right = right[order]
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    del right, differ
    found = np.zeros((m, reach), bool)
    classes = np.zeros(m, np.uint64)
    up, _ = powers(length + 1)
    for a in range(reach):
        if a:
            classes += _TABLE[padded[np.maximum(begin + left - a, 0)]] * up[a]
        new = np.concatenate([[True], common < length - a])
        alone = new & np.concatenate([new[1:], [True]])
        has = order[~alone]
        interval = np.cumsum(new)[~alone].astype(np.uint64)
        ok = (left[has] >= a) & (left[has] - (n[has] - 1) <= a)
        has, key = has[ok], mix64(interval[ok]) + classes[has[ok]]
        if not len(has):
            continue
        by = np.argsort(key)
        twin = key[by][1:] == key[by][:-1]
        hit = np.concatenate([twin, [False]]) | np.concatenate([[False], twin])
        found[has[by[hit]], a] = True
    return found


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and length of the runs of True."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - first


def _ranges(row_key: np.ndarray, first: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(row_key):
        yield _rows([("row_key", pa.int64(), row_key), ("first", pa.int32(), first.astype(np.int32)), ("n", pa.int32(), n.astype(np.int32))])


def _parse_order(length: int) -> Callable:
    @released
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[int, tuple[list, list, list]] = {}  # one bucket at a time
        for batch in batches:
            for bucket, kind, head, own in zip(*(batch.column(k).to_pylist() for k in ("bucket", "kind", "head", "bytes"))):
                heads, blocks, windows = packed.setdefault(bucket, ([], [], []))
                if kind == 0:
                    heads.append(head)
                    blocks.append(own)
                elif kind == 1:
                    windows.append(head)
                else:
                    known = np.frombuffer(head, _WINDOW)
                    yield from _ranges(known["row_key"], known["first"], np.ones(len(known)))
        while packed:
            heads, blocks, windows = packed.popitem()[1]
            if windows:
                every = np.frombuffer(b"".join(windows), _WINDOW)
                order, new, times = _first_of_each(every["digest"])
                every = every[order]
                every = every[every["again"] | (times > 1)[np.cumsum(new) - 1]]
                yield from _ranges(every["row_key"], every["first"], np.ones(len(every)))
            if heads:
                head, texts = np.frombuffer(b"".join(heads), _HEAD), np.frombuffer(b"".join(blocks), np.uint8)
                del heads, blocks
                size = head["size"].astype(np.int64)
                n, left = head["n"].astype(np.int64), head["left"].astype(np.int64)
                row, a, count = runs(repeated_windows(texts, np.cumsum(size) - size, left, n, length))
                yield from _ranges(head["row_key"][row], head["first"][row] + left[row] - (a + count - 1), count)

    return compare


def covered(ranges: list[tuple[int, int]], length: int, size: int) -> list[tuple[int, int]]:
    """Maximal byte runs [a, b) covered by windows first..first+n-1."""
    out: list[list[int]] = []
    for first, n in sorted(ranges):
        a, b = first, min(size, first + n - 1 + length)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_ranges(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, hot: int = HOT) -> DataFrame:
    """Rows (row_key, first, n): the windows of a document (row_key, text) that occur elsewhere too."""
    spark = docs.sparkSession
    n = partitions(spark)
    buckets = 2 * n
    blocks = docs.where(F.octet_length("text") >= length).mapInArrow(_emit_phrases(length, trigger, buckets), "bucket int, known boolean, block binary")
    marks = materialize(blocks.repartitionById(n, F.col("bucket") % n).mapInArrow(_dictionary(hot), MARKS))
    open_ = marks.where("kind > 0").groupBy("row_key").agg(F.collect_list(F.struct("first", "n", "left", "trigger", "kind")).alias("marks"))
    phrases_ = docs.join(open_, "row_key").mapInArrow(_emit_bytes(length, buckets), "bucket int, kind int, head binary, bytes binary")
    compared = phrases_.repartitionById(n, F.col("bucket") % n).mapInArrow(_parse_order(length), RANGES)
    return marks.where("kind = 0").select("row_key", "first", "n").unionByName(compared)


def remove_repeats(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, hot: int = HOT) -> DataFrame:
    """All columns of docs with n_bytes, spans (removed runs), kept (binary: the remaining bytes) and kept_text (their
    whole characters; a character that is cut goes)."""
    kept_columns = [c for c in docs.columns if c not in ("n_bytes", "spans", "kept", "kept_text")]
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.struct(*[c for c in kept_columns if c != "text"]).alias("own"), "text")
    found = repeated_ranges(keyed.select("row_key", "text"), length, trigger, hot)
    ranges = found.groupBy("row_key").agg(F.collect_list(F.struct("first", "n")).alias("ranges"))
    span = F.struct(F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("end"))
    schema = keyed.select("own", "text", F.lit(0).cast("long").alias("n_bytes"), F.array(span).alias("spans"), F.lit(b"").alias("kept"), F.lit("").alias("kept_text")).schema

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sizes, spans, kept, whole = [], [], [], []
                for text, own in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist()):
                    data = (text or "").encode()
                    gone = covered([(r["first"], r["n"]) for r in own or ()], length, len(data))
                    sizes.append(len(data))
                    spans.append([{"first": a, "end": b} for a, b in gone])
                    rest = [data[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(data)])]
                    kept.append(b"".join(rest))
                    whole.append("".join(x.decode(errors="ignore") for x in rest))
                yield pa.RecordBatch.from_arrays([part.column("own"), part.column("text"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(whole, pa.string())], names=[f.name for f in schema.fields])

    out = keyed.join(ranges, "row_key", "left").mapInArrow(cut, schema)
    return out.select(*["text" if c == "text" else F.col("own").getField(c).alias(c) for c in kept_columns], "n_bytes", "spans", "kept", "kept_text")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["first"])
    return remove_repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Hexadecimal strings stand for bytes.  Every window of 200 bytes is hashed and counted, so this is for small tables.
OP2_SQL = """
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, len(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents
), windows AS (
    SELECT r, i, md5_number(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT r, x, unnest(range(0, n - 199)) AS i FROM docs WHERE n >= 200)
), repeated AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS times FROM windows) WHERE times > 1
), runs AS (
    SELECT r, min(i) AS a, max(i) + 200 AS z FROM (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM repeated)) GROUP BY r, run
), kept AS (
    SELECT r, coalesce(lag(z) OVER w, 0) AS a, a AS z FROM runs WINDOW w AS (PARTITION BY r ORDER BY a)
    UNION ALL SELECT r, coalesce(max(runs.z), 0), any_value(n) FROM docs LEFT JOIN runs USING (r) GROUP BY r
), texts AS (
    SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n_bytes, any_value(n) - sum(z - a) AS n_removed, sha256(unhex(string_agg(substr(x, 2 * a + 1, 2 * (z - a)), '' ORDER BY a, z))) AS kept_sha256 FROM kept JOIN docs USING (r) GROUP BY r
)
SELECT doc_id, n_bytes, n_removed::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, kept_sha256 FROM texts LEFT JOIN (SELECT r, count(*) AS n_spans FROM runs GROUP BY r) USING (r)
"""
