"""Importance resampling towards a target distribution, on hashed features.

Features are all runs of 1 to ``orders`` words; a feature's bucket is the CRC-32 of its bytes modulo ``buckets``.  A
bucket's gain is the logarithm of its share in the target over its share in the corpus, a document's weight the mean
gain of its features, and a draw without replacement takes the highest sums of weight and a Gumbel variate that the id
alone decides.

CRCs are made by matrices: the features of a slice are dealt by length, each length's distinct ones form one
two-dimensional byte array, whose columns update all CRCs at once, and the buckets are scattered back to the places of
the features.  Features of over LONG bytes, of which one array would need as many steps, have their CRCs one by one.

Two scans of the corpus: counts (one row for each bucket and task reach the shuffle), then weights.  The driver gets the
bucket counts and a histogram of scores, whose range the gains bound; ranks are counted in ranges that follow the
shuffle partitions, and only for documents at or above the threshold.

Defined results: null and empty texts have no features and weight 0; texts of any length are taken whole; a null id has
the Gumbel variate of an empty text; rows with equal scores and ids are drawn in an unspecified order, one rank each;
empty tables give empty counts and an empty draw; further columns are ignored but for those in ``keep``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, slices
from .words import compact, parted_by, runs

#: Bytes that part words: all of ASCII but digits and letters.
PARTING = parted_by((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LONG = 512
_SEQUENCE = (1 << 33) - 1  # monotonically_increasing_id has the row's place in these bits


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()


def crc_columns(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a matrix of bytes, column by column."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in matrix.T:
        crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def _distinct_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and of each row which of them it is."""
    n, length = matrix.shape
    padded = np.zeros((n, -(-length // 8) * 8), np.uint8)
    padded[:, :length] = matrix
    codes = padded.view(np.uint64)
    if codes.shape[1] == 1:
        _, first, which = np.unique(codes[:, 0], return_index=True, return_inverse=True)
        return matrix[first], which
    order = np.lexsort(codes.T)
    new = np.concatenate([[True], (codes[order[1:]] != codes[order[:-1]]).any(axis=1)])
    which = np.empty(n, np.int64)
    which[order] = np.cumsum(new) - 1
    return matrix[order[new]], which


def crcs(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte range of data."""
    out, lengths = np.empty(len(first), np.uint32), end - first
    order = np.argsort(lengths, kind="stable")
    found, at = np.unique(lengths[order], return_index=True)
    for length, a, z in zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(order)]):
        own = order[a:z]
        if length > LONG:
            out[own] = [zlib.crc32(data[b : b + length]) for b in first[own].tolist()]
            continue
        matrix = np.empty((len(own), length), np.uint8)
        for k in range(length):
            matrix[:, k] = data[first[own] + k]
        rows, which = _distinct_rows(matrix)
        out[own] = crc_columns(rows)[which]
    return out


def _features(texts: list[str | None], orders: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order the buckets of all runs of so many words, how many each text has, and the texts' words."""
    data, first, end, bounds = compact(texts, PARTING)
    for n in range(1, orders + 1):
        start, each = runs(bounds, n)
        yield (crcs(data, first[start], end[start + n - 1]) % np.uint32(buckets)).astype(np.int64), each, np.diff(bounds)


def bucket_counts(texts: DataFrame, orders: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket; every task counts its own before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for own, _, _ in _features(part.column("text").to_pylist(), orders, buckets):
                    total += np.bincount(own, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(buckets, np.int64)
    for r in rows:  # at most `buckets` rows
        found[r["bucket"]] = r["n"]
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's shares, each count raised by one."""
    s, t, n = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that the id decides."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weights(docs: DataFrame, gain: np.ndarray, orders: int, keep: Sequence[str] = ()) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight and the columns to keep)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # as long as there are buckets
    names = ["doc_id", *keep]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for part in slices(batch, "body"):
                n, total, words = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64), None
                for own, each, words in _features(part.column("body").to_pylist(), orders, len(gain)):
                    sums = np.concatenate([[0], np.cumsum(gain[own])])
                    last = np.cumsum(each)
                    n, total = n + each, total + sums[last] - sums[last - each]
                columns = [part.column(c) for c in names] + [pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "n_features", "weight"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, F.col("text").alias("body")).mapInArrow(weigh, f"{kinds}, n_words long, n_features long, weight long")


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds rank, from 1, by falling score, then id: ranges are sorted on their own and numbered on from those before."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit(_SEQUENCE))))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))  # a row a range
    return dealt.join(F.broadcast(ahead), "part").withColumn("rank", F.col("ahead") + F.col("place") + 1).drop("part", "place", "ahead")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, orders: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, keep: Sequence[str] = ()) -> DataFrame:
    """All rows (doc_id, n_features, weight, score, rank and the columns to keep); rank is null where a row is not drawn.

    Of the documents with ``least_words`` words or more ``percent`` in a hundred are drawn.
    """
    gain = gains(bucket_counts(docs, orders, buckets), bucket_counts(target, orders, buckets))
    scored = weights(docs, gain, orders, keep).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()))
    apt = F.col("n_words") >= least_words
    histogram = scored.where(apt).groupBy("score").count().orderBy(F.desc("score")).collect()  # scores lie in a range that gains bound
    left, threshold = percent * sum(r["count"] for r in histogram) // 100, None
    most = left
    for r in histogram:
        if left <= 0:
            break
        threshold, left = r["score"], left - r["count"]
    near = apt & (F.col("score") >= threshold) if threshold is not None else F.lit(False)
    drawn = _ranked(scored.where(near)).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank", *keep]
    return drawn.select(*columns).unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
goals AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
own AS (SELECT doc_id, unnest(words) AS w FROM docs),
s AS (SELECT w, count(*) AS n FROM own GROUP BY w),
t AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM goals) GROUP BY w),
coded AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(w))), lambda k: CAST('0x' || substr(hex(encode(w)), 2 * k + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT w FROM s UNION SELECT w FROM t) AS every, tab
),
counts AS (
  SELECT bucket, sum(coalesce(s.n, 0))::DOUBLE AS s, sum(coalesce(t.n, 0))::DOUBLE AS t
  FROM coded LEFT JOIN s ON coded.w = s.w LEFT JOIN t ON coded.w = t.w GROUP BY bucket
),
totals AS (SELECT sum(s) AS s, sum(t) AS t FROM counts),
gain AS (SELECT w, floor(1000e0 * ln((c.t + 1) * (totals.s + 10000e0) / ((c.s + 1) * (totals.t + 10000e0)))) AS g FROM coded JOIN counts AS c USING (bucket), totals),
sums AS (SELECT own.doc_id, count(*) AS n, sum(g) AS g FROM own JOIN gain USING (w) GROUP BY own.doc_id),
weighed AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN floor(g / n)::BIGINT ELSE 0 END AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) AS h
  FROM docs LEFT JOIN sums USING (doc_id)
),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000e0 * ln(-ln((h + 0.5e0) / 4294967296e0)))::BIGINT AS score FROM weighed),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn ON scored.doc_id = drawn.doc_id
"""
