"""Approximate nearest neighbours by cosine: NN-descent builds a neighbour graph, queries search it greedily.

Equal vectors are one node, which keeps the least ids that have it.

Building.  Nodes start with the best of TURNS cells of random hyperplanes, of about CELL vectors each (larger cells are
parted at random), so a round costs the same for each vector however many there are, and of one random group of about
RANDOM nodes, so that a node far from all others has neighbours as well.
Each round brings together, at every node, its neighbours and the nodes it is a neighbour of, with their vectors (half
precision); all pairs among them are measured and each node keeps its best DEGREE.  Rounds end when the mean likeness
of neighbours hardly rises.

Searching.  A query starts at its own node and at ENTRIES nodes chosen by hash, so it always meets enough of them.  Each
hop expands, by a join with the graph, those of the BEAM best nodes met that are not yet expanded; hops go on until no
query has one.  The WIDE best met are then measured on the original vectors in double precision.

Defined results: rows with a null id, or with a vector that is null, empty, zero, of another length than most, or that
holds null or non-finite components, take no part; of repeated ids the least vector counts; with fewer rows than asked for
all are returned; ties go to the smaller id; vectors of any length are taken whole; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bucket, materialize, mix64, partitions

DEGREE = 24
#: Candidates that a member of a neighbourhood learns of from it in a round; it keeps the DEGREE best of all.
OFFERS = 8
GAIN = 0.001
CELL, TURNS, RANDOM = 512, 16, 32
BEAM, WIDE, ENTRIES = 144, 176, 8
#: Expanded nodes whose members are measured at once: a few MB, however large a batch is.
EXPANDED = 512
_MEMBER = "struct<id:long,half:binary,least:float>"


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (id, vector as array<double>) that take part."""
    v = F.col(column)
    fine = v.isNotNull() & F.col(key).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(fine).select(F.col(key).alias("id"), v.cast("array<double>").alias("vector")).groupBy("id").agg(F.min("vector").alias("vector"))
    common = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("vector") == (common["size"] if common else 0))


def distinct_vectors(rows: DataFrame, copies: int) -> DataFrame:
    """Rows (id, vector, ids, half): of each vector its least id, its ``copies`` least ids, and it as a unit vector in half
    precision."""
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    nodes = rows.withColumn("place", place).where(F.col("place") <= copies).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column("vector").to_numpy(zero_copy_only=False))
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([h.tobytes() for h in x.astype(np.float16)], pa.binary())], names=["id", "vector", "ids", "half"])

    return nodes.select(F.col("ids")[0].alias("id"), "vector", "ids").mapInArrow(halve, "id long, vector array<double>, ids array<long>, half binary")


def _floats(halves: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(halves), np.float16).reshape(len(halves), -1).astype(np.float32)


_OFFER = np.dtype([("node", "<i8"), ("other", "<i8"), ("like", "<f4")])


def _meet(buckets: int, offers: int, degree: int) -> Callable:
    """Measures all pairs of each neighbourhood; sends every member its best new ones and the centre its best of all."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, centres = [], batch.column("centre")
            members = batch.column("members")
            flat, bounds = members.values.slice(members.offsets[0].as_py()), members.offsets.to_numpy() - members.offsets[0].as_py()
            ids_all, half_all, least_all = flat.field("id").to_numpy(), flat.field("half").to_pylist(), flat.field("least").to_numpy(zero_copy_only=False)
            for centre, a, z in zip(centres.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                ids, first = np.unique(ids_all[a:z], return_index=True)
                if len(ids) < 2:
                    continue
                x, least = _floats([half_all[a + i] for i in first]), least_all[a:z][first]
                like = x @ x.T
                np.fill_diagonal(like, -2)
                width = min(offers, len(ids) - 1)
                best = np.argpartition(-like, width - 1, axis=1)[:, :width]
                value = np.take_along_axis(like, best, axis=1)
                row, col = np.nonzero(value > least[:, None])
                own = np.empty(len(row), _OFFER)
                own["node"], own["other"], own["like"] = ids[row], ids[best[row, col]], value[row, col]
                out.append(own)
                at = np.flatnonzero(ids == centre)
                if len(at):
                    mine = like[at[0]]
                    top = np.argsort(-mine, kind="stable")[: min(degree, len(ids) - 1)]
                    own = np.empty(len(top), _OFFER)
                    own["node"], own["other"], own["like"] = centre, ids[top], mine[top]
                    out.append(own)
            if out:
                every = np.concatenate(out)
                rows = [(b, every[at].tobytes()) for b, at in by_bucket(every["node"].view(np.uint64), buckets)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], names=["bucket", "block"])

    return meet


def _keep(degree: int) -> Callable:
    """The best of all offers to each node."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [np.frombuffer(x, _OFFER) for batch in batches for x in batch.column("block").to_pylist()]
        if not blocks:
            return
        every = np.concatenate(blocks)
        every = every[np.lexsort((every["other"], every["node"]))]
        every = every[np.concatenate([[True], (every["node"][1:] != every["node"][:-1]) | (every["other"][1:] != every["other"][:-1])])]
        every = every[np.lexsort((every["other"], -every["like"], every["node"]))]
        first = np.flatnonzero(np.concatenate([[True], every["node"][1:] != every["node"][:-1]]))
        rank = np.arange(len(every)) - np.repeat(first, np.diff([*first, len(every)]))
        every = every[rank < degree]
        first = np.flatnonzero(np.concatenate([[True], every["node"][1:] != every["node"][:-1]]))
        offsets = pa.array(np.concatenate([first, [len(every)]]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(every[k])) for k in ("other", "like")]
        full = np.diff(np.concatenate([first, [len(every)]])) >= degree
        least = np.where(full, np.minimum.reduceat(every["like"], first), np.float32(-2))
        yield pa.RecordBatch.from_arrays([pa.array(every["node"][first]), *lists, pa.array(least, pa.float32())], names=["id", "others", "likes", "least"])

    return keep


def _round(groups: DataFrame, n: int, degree: int) -> DataFrame:
    """From neighbourhoods (centre, members) each node's best."""
    offers = groups.mapInArrow(_meet(2 * n, OFFERS, degree), "bucket int, block binary")
    return offers.repartition(n, "bucket").mapInArrow(_keep(degree), "id long, others array<long>, likes array<float>, least float")


def _cells(halves: DataFrame, rows: int, n: int) -> DataFrame:
    """First neighbourhoods: cells of random hyperplanes, TURNS times, large ones parted at random, and random groups."""
    groups = max(1, rows // RANDOM)
    bits = max(0, int(np.log2(max(1, rows / CELL))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _floats(batch.column("half").to_pylist())
                for turn in range(TURNS):
                    planes = np.random.default_rng(turn).standard_normal((x.shape[1], bits)).astype(np.float32)
                    cell = ((x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))) * (TURNS + 1) + turn if bits else np.full(len(x), turn)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), *batch.columns], names=["cell", "id", "half"])
                mixed = mix64(batch.column("id").to_numpy().view(np.uint64)) >> np.uint64(1)
                cell = (mixed % np.uint64(groups)).astype(np.int64) * (TURNS + 1) + TURNS
                yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], names=["cell", "id", "half"])

    coded = materialize(halves.select("id", "half").mapInArrow(code, "cell long, id long, half binary"))
    sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / (2 * CELL)).alias("parts"))
    parted = coded.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id", "cell"), F.col("parts")))
    member = F.struct("id", "half", F.lit(-2.0).cast("float").alias("least")).cast(_MEMBER)
    return parted.groupBy("cell", "part").agg(F.collect_list(member).alias("members")).select(F.lit(None).cast("long").alias("centre"), "members")


def neighbourhoods(graph: DataFrame, halves: DataFrame, degree: int) -> DataFrame:
    """(centre, members) with each node's neighbours, itself, and up to ``degree`` nodes that it is a neighbour of."""
    edges = graph.select("id", F.explode("others").alias("other"))
    place = F.row_number().over(Window.partitionBy("other").orderBy(F.xxhash64("id", "other")))
    back = edges.withColumn("place", place).where(F.col("place") <= degree).select(F.col("other").alias("centre"), F.col("id").alias("member"))
    pairs = edges.select(F.col("id").alias("centre"), F.col("other").alias("member")).unionByName(back).unionByName(graph.select(F.col("id").alias("centre"), F.col("id").alias("member")))
    known = halves.select("id", "half").join(graph.select("id", "least"), "id", "left").select(F.col("id").alias("member"), F.struct("id", "half", F.coalesce("least", F.lit(-2.0)).cast("float").alias("least")).cast(_MEMBER).alias("item"))
    return pairs.join(known, "member").groupBy("centre").agg(F.collect_list("item").alias("members"))


def build_graph(halves: DataFrame, degree: int = DEGREE) -> DataFrame:
    """Rows (id, others, likes, least): the neighbour graph."""
    n = partitions(halves.sparkSession)
    graph = materialize(_round(_cells(halves, halves.count(), n), n, degree))
    before = 0.0
    while True:
        graph = materialize(_round(neighbourhoods(graph, halves, degree), n, degree))
        now = graph.agg(F.avg(F.aggregate("likes", F.lit(0.0), lambda a, x: a + x) / F.size("likes"))).first()[0] or 0.0
        if now - before <= GAIN * abs(now):
            return graph
        before = now


_FOUND = "query_id long, ids array<long>, likes array<float>"
_STATE = "query_id long, query_half binary, ids array<long>, likes array<float>, done array<boolean>, next array<long>, least float"


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of lists in one array and how many each list has."""
    if not len(lists):  # offsets of no lists may hold anything
        return lists.values.slice(0, 0), np.zeros(0, np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), np.diff(offsets)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Likeness of a query to the members of a node that it expands; those below its BEAM best so far are left out."""
    for whole in batches:
        for a in range(0, whole.num_rows, EXPANDED):
            batch = whole.slice(a, EXPANDED)
            members, sizes = _flat(batch.column("members"))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            x, q = _floats(members.field("half").to_pylist()), _floats(batch.column("query_half").to_pylist())
            likes = np.einsum("ij,ij->i", x, q[row])
            keep = likes >= batch.column("least").to_numpy()[row] - 1e-3
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=batch.num_rows))]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (members.field("id").to_numpy()[keep], likes[keep])]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), *lists], names=["query_id", "ids", "likes"])


def _advance(beam: int, wide: int) -> Callable:
    """Keeps the ``wide`` best that each query met and names those of the ``beam`` best that it has not expanded."""

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            old, sizes = _flat(batch.column("ids"))
            finds, times = _flat(batch.column("found"))
            new, each = _flat(finds.field("ids"))
            query = np.concatenate([np.repeat(np.arange(batch.num_rows), sizes), np.repeat(np.repeat(np.arange(batch.num_rows), times), each)])
            ids = np.concatenate([old.to_numpy(), new.to_numpy()])
            likes = np.concatenate([_flat(batch.column("likes"))[0].to_numpy(), _flat(finds.field("likes"))[0].to_numpy()])
            done = np.concatenate([_flat(batch.column("done"))[0].to_numpy(zero_copy_only=False), np.zeros(len(new), bool)])
            order = np.lexsort((~done, ids, query))
            query, ids, likes, done = query[order], ids[order], likes[order], done[order]
            first = np.concatenate([[True], (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])]) if len(ids) else np.zeros(0, bool)
            query, ids, likes, done = query[first], ids[first], likes[first], done[first]
            order = np.lexsort((ids, -likes, query))
            query, ids, likes, done = query[order], ids[order], likes[order], done[order]
            starts = np.searchsorted(query, np.arange(batch.num_rows))
            rank = np.arange(len(ids)) - starts[query]
            least = np.full(batch.num_rows, -2, np.float32)
            at = rank == beam - 1
            least[query[at]] = likes[at]
            ahead = ~done & (rank < beam)
            kept = rank < wide
            to = lambda v, chosen: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(query[chosen], minlength=batch.num_rows))]), pa.int32()), pa.array(v[chosen]))
            columns = [batch.column("query_id"), batch.column("query_half"), to(ids, kept), to(likes, kept), to(done | ahead, kept), to(ids, ahead), pa.array(least)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _STATE.split(", ")])

    return advance


def search(halves: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = BEAM, wide: int = WIDE) -> DataFrame:
    """Rows (query_id, ids, likes): the best nodes that the search from each query's own node (column id) met, itself among
    them."""
    around = materialize(neighbourhoods(graph, halves, DEGREE).withColumnRenamed("centre", "id"))
    entries = [r["id"] for r in halves.select("id").orderBy(F.xxhash64("id"), "id").limit(ENTRIES).collect()]
    none = F.array().cast("array<long>")
    start = F.array_distinct(F.concat(F.array("id"), F.array(*map(F.lit, entries)).cast("array<long>")))
    state = halves.join(queries, "id", "left_semi").select(
        F.col("id").alias("query_id"), F.col("half").alias("query_half"), none.alias("ids"), F.array().cast("array<float>").alias("likes"),
        F.array().cast("array<boolean>").alias("done"), start.alias("next"), F.lit(-2.0).cast("float").alias("least"),
    )
    empty = F.array().cast("array<struct<ids:array<long>,likes:array<float>>>")
    while True:
        ahead = state.select("query_id", "query_half", "least", F.explode("next").alias("id")).join(around, "id")
        found = ahead.select("query_id", "query_half", "least", "members").mapInArrow(_score, _FOUND)
        gathered = found.groupBy("query_id").agg(F.collect_list(F.struct("ids", "likes")).alias("found"))
        joined = state.join(gathered, "query_id", "left").withColumn("found", F.coalesce("found", empty))
        state = materialize(joined.mapInArrow(_advance(beam, wide), _STATE))
        if state.where(F.size("next") > 0).isEmpty():
            return state.select("query_id", "ids", "likes")


def cosine(a: Column, b: Column) -> Column:
    """In double precision, scaled so that neither very large nor very small components overflow."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    scaled = lambda x: F.transform(x, lambda p: p / F.array_max(F.transform(x, lambda q: F.abs(q))))
    a, b = scaled(a), scaled(b)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, queries: Column, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, id, score): the k nearest found of each row that meets ``queries`` (a condition on id)."""
    rows = materialize(usable(vectors, key, column))
    nodes = materialize(distinct_vectors(rows, k + 1))
    asked = materialize(rows.where(queries).select(F.col("id").alias("query_id"), "vector").join(nodes.select("id", "vector"), "vector").select("query_id", "id"))
    halves = nodes.select("id", "half")
    met = search(halves, build_graph(halves), asked)
    pairs = met.select(F.col("query_id").alias("of"), F.explode("ids").alias("id"))
    exact = pairs.join(nodes.select("id", "ids", F.col("vector").alias("b")), "id").join(nodes.select(F.col("id").alias("of"), F.col("vector").alias("a")), "of")
    scored = exact.select("of", "ids", cosine(F.col("a"), F.col("b")).alias("score")).select("of", "score", F.explode("ids").alias("id"))
    place = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("score"), "id"))
    best = scored.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("of").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("best"))
    own = asked.join(best, asked["id"] == best["of"]).select("query_id", F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.id", "x.score")


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = nearest(vectors, F.col("id") % 50 == 0, 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
