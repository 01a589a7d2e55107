"""python -m tidegrid: maps of videos, splits of a manifest, training and scoring, metrics of runs, and registered queries, from tables to tables."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import build
from .config import DEFAULT
from .operators import catalog, experiment, metrics, splits, training
from .plans import registry

READOUTS = ("psd_sum", "mean", "median", "snr_mean")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidegrid", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("splits", help="split by person: rows (dataset, subject, sid, part)")
    one.add_argument("--manifest", required=True)
    one.add_argument("--seed", type=int, default=DEFAULT.seed)
    one.add_argument("--variant", choices=("full", "sonly"), default="full")
    one.add_argument("--train-only", nargs="*", default=[], help="datasets that are never evaluated")
    two = commands.add_parser("evaluate", help="metrics of each run on each of its sets")
    two.add_argument("--predictions", required=True, help="rows (run, sid, readout, bpm)")
    two.add_argument("--sets", required=True, help="rows (run, dataset, subset, sid)")
    two.add_argument("--manifest", required=True)
    two.add_argument("--readout", choices=READOUTS, default=READOUTS[0])
    two.add_argument("--subgroups", action="store_true")
    three = commands.add_parser("query", help="a registered query on a folder of tables")
    three.add_argument("name", choices=sorted(registry.queries()), metavar="name")
    three.add_argument("--data", required=True)
    four = commands.add_parser("train", help="train a pool of corpora for some seeds, score test sessions, and their metrics")
    four.add_argument("--maps", required=True, help="rows (sid, roi, x)")
    four.add_argument("--split", required=True, help="rows (dataset, subject, sid, part)")
    four.add_argument("--manifest", required=True)
    four.add_argument("--train", required=True, type=lambda s: s.split(","), help="corpora of the pool, parted by commas")
    four.add_argument("--eval", default=["cohface", "mahnob"], type=lambda s: s.split(","), help="corpora whose test sessions are scored")
    four.add_argument("--seed", type=int, nargs="+", default=[DEFAULT.seed])
    four.add_argument("--epochs", type=int, default=training.TrainConfig.epochs)
    four.add_argument("--steps", type=int, default=training.TrainConfig.steps)
    four.add_argument("--bs", type=int, default=training.TrainConfig.batch)
    four.add_argument("--replicas", type=int, default=1, help="batches whose gradients make one step")
    four.add_argument("--tag", default="run")
    four.add_argument("--readout", choices=READOUTS, default=READOUTS[0])
    five = commands.add_parser("maps", help="maps of sessions with raw AVI videos; what is stored already is not done again")
    five.add_argument("--sessions", required=True, help="rows (sid, dataset, fps, video, and descriptors)")
    five.add_argument("--videos", required=True, help="folder of the videos")
    five.add_argument("--detections", help="rows (sid, frame, x, y, w, h, score); none: frames are cropped already")
    five.add_argument("--limit", type=int, help="sessions of each dataset")
    five.add_argument("--retry-skipped", action="store_true", help="only sessions that are not finished")
    five.add_argument("--jobs", type=int, help="tasks that read videos at a time")
    for each in (one, two, three, four, five):
        each.add_argument("--out", required=True)
        each.add_argument("--force", action="store_true", help="replace what is there")
    return top


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    """Folders losses, checkpoints (both resumable), best, predictions and metrics below --out."""
    config = training.TrainConfig(epochs=args.epochs, steps=args.steps, batch=args.bs, replicas=args.replicas)
    tables = (spark.read.parquet(p) for p in (args.maps, args.split, args.manifest))
    found = experiment.train_and_score(*tables, args.train, args.eval, args.seed, args.out, args.tag, args.readout, config=config)
    for name, rows in (("best", found.best), ("predictions", found.predictions), ("metrics", found.cells)):
        rows.write.mode("overwrite" if args.force else "error").parquet(f"{args.out}/{name}")


def build_maps(spark: SparkSession, args: argparse.Namespace) -> None:
    """Stores maps and records below --out, and prints the number of sessions by status."""
    none = spark.createDataFrame([], "sid string, frame int, x double, y double, w double, h double, score double")
    seen = spark.read.parquet(args.detections) if args.detections else none
    rows = build.video_maps(
        spark.read.parquet(args.sessions), args.videos, seen, args.out, args.jobs, limit=args.limit, retry_skipped=args.retry_skipped, force=args.force, whole=not args.detections
    )
    catalog.status_histogram(rows).show(truncate=False)


def result(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.command == "query":
        return registry.queries()[args.name](spark, args.data)
    manifest = spark.read.parquet(args.manifest)
    if args.command == "splits":
        return splits.build(manifest, args.train_only, args.variant, seed=args.seed)
    preds = spark.read.parquet(args.predictions).where(F.col("readout") == args.readout).drop("readout")
    how = metrics.run_subgroups if args.subgroups else metrics.run_cells
    return how(preds, spark.read.parquet(args.sets), manifest)


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidegrid").getOrCreate()
    if args.command == "train":
        train(spark, args)
        return
    if args.command == "maps":
        build_maps(spark, args)
        return
    result(spark, args).write.mode("overwrite" if args.force else "error").parquet(args.out)


if __name__ == "__main__":
    main()
