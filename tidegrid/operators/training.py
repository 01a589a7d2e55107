"""Self-supervised training of the network on maps: a grid of runs in one synchronous, data-parallel loop.

A run is a pool of training and validation sessions; each run is trained once for each seed.  Every epoch cuts its clips in
one job, which reads the maps once for the whole grid and writes the clips by step.  Every step is one job of which each
group is one batch: (run, seed, replica) with its ``batch`` pairs of views, whose loss needs them together.  Gradients of
the replicas are summed in a tree, in the order of their numbers, and AdamW moves the weights on the driver; weights,
moments and gradients are all that reaches it, for at most ``together`` trainings at a time.

Draws follow from (run, seed, epoch, step, replica, item), never from partitions, so a training gives the same numbers
however its tables are parted and whatever is computed again.  Validation takes the same clips in every epoch, and the
first epoch with the least validation loss is kept (training loss where a run has no validation sessions; NaN never wins).

Defined results: sessions without a map or with a map too short for the longest clip are left out; a run with fewer than
two usable training sessions is an error that names it; repeated sessions of a run count once.  Finished trainings are
found in ``store`` and not done again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import contrast, physnet
from .metrics import best_checkpoint
from .scratch import shared_folder

#: Draws of an epoch that are broadcast; more are joined without a hint.
MOST_DRAWS = 200_000
FAN = 16
LOSSES = "run string, seed long, epoch int, train_loss double, val_loss double"
TENSORS = "run string, seed long, name string, shape array<int>, values array<float>"
_CLIPS = "run string, seed long, step int, replica int, item int, width int, a binary, b binary"
_KEY = ["run", "seed"]
_TRAIN, _VAL = 0, 1


@dataclass(frozen=True)
class TrainConfig:
    # Epochs, steps, pairs of a batch, batches of a validation, rate; noise as a share of a view's deviation.
    epochs: int = 30
    steps: int = 60
    batch: int = 32
    val_batches: int = 20
    rate: float = 1e-4
    noise: float = 0.05
    val_seed: int = 1234
    clip: int = DEFAULT.clip
    warp_minus: int = DEFAULT.warp_minus
    warp_plus: int = DEFAULT.warp_plus
    slack: int = 10
    fs: float = DEFAULT.fs_train
    low: float = DEFAULT.low
    high: float = DEFAULT.high
    tau: float = DEFAULT.tau
    # AdamW's usual constants.
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    decay: float = 0.01
    # Ours: batches whose gradients make one step, trainings in one loop, widths of the network.
    replicas: int = 1
    together: int = 8
    stem: int = physnet.STEM
    width: int = physnet.WIDTH

    @property
    def least(self) -> int:
        """Columns that a map needs."""
        return self.clip + self.warp_plus + self.slack


# ── clips ────────────────────────────────────────────────────────────────────────────────────────
def flat_maps(maps: DataFrame, sid: str = "sid", roi: str = "roi", x: str = "x") -> DataFrame:
    """Maps (sid, channels, x) with all channels in one array, from one row for each channel."""
    rows = maps.groupBy(sid).agg(F.sort_array(F.collect_list(F.struct(roi, x))).alias("_rows"))
    return rows.select(F.col(sid).alias("sid"), F.size("_rows").alias("channels"), F.flatten(F.transform("_rows", lambda r: r[x])).cast("array<float>").alias("x"))


def views(m: np.ndarray, rng: np.random.Generator, config: TrainConfig) -> tuple[np.ndarray, np.ndarray]:
    """Two noisy, standardised views of one clip: its even and its odd channels, with one length and start for both."""
    size = int(rng.integers(config.clip - config.warp_minus, config.clip + config.warp_plus + 1))
    start = int(rng.integers(0, m.shape[1] - size + 1))
    at = np.linspace(0, size - 1, config.clip)
    low = np.floor(at).astype(int)
    share = (at - low).astype(np.float32)
    part = m[:, start : start + size].astype(np.float32)
    part = part[:, low] * (1 - share) + part[:, np.minimum(low + 1, size - 1)] * share
    out = []
    for half in (part[0::2], part[1::2]):
        noisy = half + rng.normal(0, config.noise * (half.std() + 1e-6), half.shape).astype(np.float32)
        out.append(((noisy - noisy.mean()) / (noisy.std() + 1e-6)).astype(np.float32))
    return out[0], out[1]


def _generator(run: str, *keys: int) -> np.random.Generator:
    return np.random.default_rng([zlib.crc32(run.encode()), *keys])


def draws(sessions: dict[str, int], seeds: dict[str, Sequence[int]], part: int, epoch: int, config: TrainConfig) -> pd.DataFrame:
    """Which session (k, in the order of sids) each item of each batch takes, with replacement."""
    rows = []
    for run, n in sessions.items():
        size = config.batch if part == _TRAIN else min(config.batch, n)
        for seed in seeds[run]:
            first = seed if part == _TRAIN else config.val_seed
            for step in range(config.steps if part == _TRAIN else config.val_batches):
                for replica in range(config.replicas if part == _TRAIN else 1):
                    picked = _generator(run, first, part, epoch, step, replica).integers(0, n, size)
                    rows += [(run, seed, step, replica, item, int(k)) for item, k in enumerate(picked)]
    return pd.DataFrame(rows, columns=["run", "seed", "step", "replica", "item", "k"])


def clips(maps: DataFrame, ranked: DataFrame, drawn: pd.DataFrame, part: int, epoch: int, config: TrainConfig) -> DataFrame:
    """Both views of each drawn session's clip."""
    spark = maps.sparkSession
    wanted = spark.createDataFrame(drawn, "run string, seed long, step int, replica int, item int, k long").join(ranked, ["run", "k"])
    wanted = F.broadcast(wanted) if len(drawn) <= MOST_DRAWS else wanted

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = batch.column("x"), batch.select(["run", "seed", "step", "replica", "item", "channels"]).to_pylist()
            out = []
            for k, r in enumerate(rows):
                first = r["seed"] if part == _TRAIN else config.val_seed
                rng = _generator(r["run"], first, part, epoch, r["step"], r["replica"], r["item"])
                a, b = views(x[k].values.to_numpy(zero_copy_only=False).reshape(r["channels"], -1), rng, config)
                out.append((r["run"], r["seed"], r["step"], r["replica"], r["item"], config.clip, a.tobytes(), b.tobytes()))
            if out:
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in _CLIPS.split(", ")])

    return maps.join(wanted, "sid").select("run", "seed", "step", "replica", "item", "channels", "x").mapInArrow(cut, _CLIPS)


# ── one batch ────────────────────────────────────────────────────────────────────────────────────
def batch_loss(a: np.ndarray, b: np.ndarray, found: physnet.Weights, config: TrainConfig, train: bool) -> tuple[float, physnet.Weights, list[physnet.Weights]]:
    """Loss of a batch of two views (batch, M, T); in training its gradients and both views' statistics."""
    spectra = []
    for x in (a, b):
        wave, tape = physnet.run(x, found, train)
        spectra.append((*contrast.band_spectra(wave[:, 0].astype(float), config.fs, config.low, config.high), tape))
    loss, *dshares = contrast.info_nce(spectra[0][0], spectra[1][0], config.tau)
    if not train:
        return loss, {}, []
    grads: physnet.Weights = {}
    for (_, held, tape), dshare in zip(spectra, dshares):
        dwave = contrast.band_spectra_back(dshare, held).astype(found["head.w"].dtype)
        for k, g in physnet.back(dwave[:, None], tape, found).items():
            grads[k] = grads[k] + g if k in grads else g
    return loss, grads, [physnet.batch_statistics(tape) for _, _, tape in spectra]


def _stacked(rows: pa.Table, column: str) -> np.ndarray:
    """Views of a batch in the order of their items."""
    order = np.argsort(rows.column("item").to_numpy())
    held = rows.column(column).to_pylist()
    return np.stack([np.frombuffer(held[k], np.float32) for k in order]).reshape(len(order), -1, rows.column("width")[0].as_py())


def _packed(parts: Sequence[np.ndarray]) -> bytes:
    return np.concatenate([p.ravel() for p in parts]).astype("<f8").tobytes()


def _step(rows: DataFrame, shared, config: TrainConfig) -> list:
    """(run, seed, loss, gradient and statistics in one array) of one step, means over its replicas."""

    def work(table: pa.Table) -> pa.Table:
        run, seed, replica = (table.column(c)[0].as_py() for c in ("run", "seed", "replica"))
        found = shared.value[run, seed]
        loss, grads, statistics = batch_loss(_stacked(table, "a"), _stacked(table, "b"), found, config, True)
        flat = _packed([np.array([loss]), *(grads[k] for k in physnet.trainable(found)), *(s[k] for s in statistics for k in sorted(s))])
        return pa.table({"run": [run], "seed": [seed], "replica": pa.array([replica], pa.int32()), "flat": pa.array([flat], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("replica").to_numpy())
        held = table.column("flat").to_pylist()
        total = np.frombuffer(held[order[0]], "<f8").copy()
        for k in order[1:]:
            total += np.frombuffer(held[k], "<f8")
        return pa.table({"run": table.column("run")[:1], "seed": table.column("seed")[:1], "replica": pa.array([table.column("replica")[order[0]].as_py() // FAN], pa.int32()), "flat": pa.array([total.tobytes()], pa.binary())})

    schema = "run string, seed long, replica int, flat binary"
    found, left = rows.groupBy("run", "seed", "replica").applyInArrow(work, schema), config.replicas
    while left > 1:
        found = found.groupBy("run", "seed", F.floor(F.col("replica") / FAN)).applyInArrow(add, schema)
        left = -(-left // FAN)
    return [(r["run"], r["seed"], np.frombuffer(r["flat"], "<f8") / config.replicas) for r in found.collect()]


def _validate(rows: DataFrame, shared, config: TrainConfig) -> dict[tuple[str, int], float]:
    """Mean loss of the validation batches of each training, in scoring mode."""

    def work(table: pa.Table) -> pa.Table:
        run, seed = table.column("run")[0].as_py(), table.column("seed")[0].as_py()
        loss, _, _ = batch_loss(_stacked(table, "a"), _stacked(table, "b"), shared.value[run, seed], config, False)
        return pa.table({"run": [run], "seed": [seed], "step": pa.array([table.column("step")[0].as_py()], pa.int32()), "loss": [loss]})

    each = rows.groupBy("run", "seed", "step").applyInArrow(work, "run string, seed long, step int, loss double").collect()
    found: dict[tuple[str, int], list] = {}
    for r in sorted(each):
        found.setdefault((r["run"], r["seed"]), []).append(r["loss"])
    return {k: float(np.mean(v)) for k, v in found.items()}


class Training:
    """Weights and moments of one training, on the driver."""

    def __init__(self, seed: int, config: TrainConfig):
        self.config, self.found = config, physnet.weights(seed, stem=config.stem, width=config.width)
        self.names = physnet.trainable(self.found)
        self.theta = np.concatenate([self.found[k].ravel() for k in self.names]).astype(float)
        self.first, self.second, self.steps = np.zeros_like(self.theta), np.zeros_like(self.theta), 0
        self.best, self.kept, self.losses = np.inf, None, []

    def step(self, flat: np.ndarray) -> float:
        """AdamW by a mean gradient; running statistics take in both views'."""
        c, n = self.config, len(self.theta)
        loss, grad, rest = flat[0], flat[1 : n + 1], flat[n + 1 :]
        self.steps += 1
        self.first = c.betas[0] * self.first + (1 - c.betas[0]) * grad
        self.second = c.betas[1] * self.second + (1 - c.betas[1]) * grad * grad
        self.theta *= 1 - c.rate * c.decay
        mean, spread = self.first / (1 - c.betas[0] ** self.steps), self.second / (1 - c.betas[1] ** self.steps)
        self.theta -= c.rate * mean / (np.sqrt(spread) + c.eps)
        at = 0
        for k in self.names:
            size = self.found[k].size
            self.found[k], at = self.theta[at : at + size].reshape(self.found[k].shape).astype(np.float32), at + size
        running = sorted(k for k in self.found if k not in self.names)
        at = 0
        for _ in range(2):
            statistics = {}
            for k in running:
                statistics[k], at = rest[at : at + self.found[k].size], at + self.found[k].size
            self.found = physnet.moved(self.found, statistics)
        return float(loss)

    def end_epoch(self, epoch: int, train_loss: float, val_loss: float, has_val: bool) -> None:
        self.losses.append((epoch, train_loss, val_loss))
        score = val_loss if has_val else train_loss
        if score < self.best:
            self.best, self.kept = score, dict(self.found)


# ── the loop ─────────────────────────────────────────────────────────────────────────────────────
def usable_sessions(maps: DataFrame, members: DataFrame, config: TrainConfig) -> DataFrame:
    """(run, part, k, sid): sessions of each run with a long enough map, numbered by sid."""
    long = maps.where((F.col("channels") >= 2 * physnet.LEAST_CHANNELS) & (F.size("x") >= F.col("channels") * config.least)).select("sid").distinct()
    rows = members.where(F.col("part").isin("train", "val")).select("run", "part", "sid").distinct().join(long, "sid", "left_semi")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("run", "part").orderBy("sid")).cast("long") - 1)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # nothing is finished yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def losses(spark: SparkSession, store: str) -> DataFrame:
    """(run, seed, epoch, train_loss, val_loss) of finished trainings."""
    done = checkpoints(spark, store).select(*_KEY).distinct()
    return _stored(spark, f"{store}/losses", LOSSES).join(done, _KEY, "left_semi").dropDuplicates([*_KEY, "epoch"])


def checkpoints(spark: SparkSession, store: str) -> DataFrame:
    """(run, seed, name, shape, values): the kept epoch's tensors of finished trainings."""
    return _stored(spark, f"{store}/checkpoints", TENSORS)


def load_weights(spark: SparkSession, store: str, run: str, seed: int) -> physnet.Weights:
    rows = checkpoints(spark, store).where((F.col("run") == run) & (F.col("seed") == seed)).collect()
    return {r["name"]: np.array(r["values"], np.float32).reshape(r["shape"]) for r in rows}


def stored_weights(spark: SparkSession, store: str) -> dict[str, physnet.Weights]:
    """The kept weights of every finished training, by name (run and seed); a network is about a megabyte."""
    found: dict[str, physnet.Weights] = {}
    for r in checkpoints(spark, store).collect():
        found.setdefault(f"{r['run']}_s{r['seed']}", {})[r["name"]] = np.array(r["values"], np.float32).reshape(r["shape"])
    return found


def best_epochs(spark: SparkSession, store: str) -> DataFrame:
    """(run, seed, best_epoch, best_loss) by validation loss, or by training loss without one."""
    told = losses(spark, store).withColumn("loss", F.when(F.max(F.col("val_loss").isNotNull()).over(Window.partitionBy(*_KEY)), F.col("val_loss")).otherwise(F.col("train_loss")))
    return best_checkpoint(told, _KEY, "epoch", "loss")


def train_grid(maps: DataFrame, members: DataFrame, seeds: Sequence[int], store: str, config: TrainConfig = TrainConfig()) -> tuple[DataFrame, DataFrame]:
    """Trains every run of ``members`` (run, sid, part) with every seed on ``maps`` (sid, channels, x); returns ``losses`` and
    ``checkpoints`` of the store."""
    spark = maps.sparkSession
    done = {(r["run"], r["seed"]) for r in checkpoints(spark, store).select(*_KEY).distinct().collect()}
    runs = sorted(r["run"] for r in members.select("run").distinct().collect())
    todo = [(run, int(seed)) for run in runs for seed in seeds if (run, int(seed)) not in done]
    if todo:
        path = shared_folder(spark, "sessions")
        usable_sessions(maps, members, config).write.parquet(path)
        ranked = spark.read.parquet(path)
        counts = {(r["run"], r["part"]): r["count"] for r in ranked.groupBy("run", "part").count().collect()}
        for run in sorted({run for run, _ in todo}):
            if counts.get((run, "train"), 0) < 2:
                raise ValueError(f"run {run!r} has {counts.get((run, 'train'), 0)} usable training sessions; it needs two")
        for k in range(0, len(todo), config.together):
            _train(maps, ranked, counts, todo[k : k + config.together], store, config)
    return losses(spark, store), checkpoints(spark, store)


def _train(maps: DataFrame, ranked: DataFrame, counts: dict, todo: list[tuple[str, int]], store: str, config: TrainConfig) -> None:
    spark, state = maps.sparkSession, {key: Training(key[1], config) for key in todo}
    seeds = {run: [s for r, s in todo if r == run] for run, _ in todo}
    sizes = {part: {run: counts[run, part] for run in seeds if counts.get((run, part))} for part in ("train", "val")}
    place, checks = shared_folder(spark, "clips"), None
    share = lambda: spark.sparkContext.broadcast({key: t.found for key, t in state.items()})
    if sizes["val"]:
        path = shared_folder(spark, "checks")
        own = ranked.where("part = 'val'").select("run", "k", "sid")
        clips(maps, own, draws(sizes["val"], seeds, _VAL, 0, config), _VAL, 0, config).write.parquet(path)
        checks = spark.read.schema(_CLIPS).parquet(path)
    for epoch in range(config.epochs):
        own = ranked.where("part = 'train'").select("run", "k", "sid")
        clips(maps, own, draws(sizes["train"], seeds, _TRAIN, epoch, config), _TRAIN, epoch, config).write.mode("overwrite").partitionBy("step").parquet(place)
        cut, total = spark.read.schema(_CLIPS).parquet(place), dict.fromkeys(todo, 0.0)
        for step in range(config.steps):
            shared = share()
            for run, seed, flat in _step(cut.where(F.col("step") == step), shared, config):
                total[run, seed] += state[run, seed].step(flat)
            shared.unpersist()
        shared = share()
        checked = _validate(checks, shared, config) if checks is not None else {}
        shared.unpersist()
        for key, t in state.items():
            t.end_epoch(epoch, total[key] / config.steps, checked.get(key, float("nan")), key in checked)
    rows = [(*key, e, a, None if key[0] not in sizes["val"] else b) for key, t in state.items() for e, a, b in t.losses]
    spark.createDataFrame(rows, LOSSES).write.mode("append").parquet(f"{store}/losses")
    kept = [(*key, k, list(v.shape), v.ravel().tolist()) for key, t in state.items() for k, v in (t.kept or t.found).items()]
    spark.createDataFrame(kept, TENSORS).coalesce(1).write.mode("append").parquet(f"{store}/checkpoints")  # ends a training


