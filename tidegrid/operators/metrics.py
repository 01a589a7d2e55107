"""Agreement of predictions with references: one grouped aggregation for all scalar metrics, ICC(1,1), subgroups.

Rows without a reference, or with a prediction that is null or not finite, are not evaluated.  Groups of one row have a
NaN correlation, as have constant columns; groups without any row are absent (``complete`` adds them with n = 0).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")
#: What a test set of each corpus is broken down by.
SUBGROUP = {"mahnob": "trial", "pure": "head_motion", "cohface": "illumination"}


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def eligible(pairs: DataFrame, pred: str = "pred", ref: str = "ref") -> DataFrame:
    return pairs.where(finite(F.col(pred)) & F.col(ref).isNotNull())


def pearson(p: str, g: str) -> Column:
    """Correlation that is NaN, not an error, for constant columns and single rows."""
    spread = F.stddev_pop(p) * F.stddev_pop(g)
    return F.when(spread > 0, F.try_divide(F.covar_pop(p, g), spread)).otherwise(F.lit(NAN))


def icc11(rows: DataFrame, by: Sequence[str], person: str, value: str) -> DataFrame:
    """ICC(1,1) of a value within persons; persons with two rows or more count, and two of them are needed.

    From count, sum and sum of squared deviations of each person, so the rows are shuffled once.
    """
    each = rows.groupBy(*by, person).agg(F.count("*").cast("double").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where("n >= 2")
    grand = each.groupBy(*by).agg(
        F.count("*").cast("double").alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.sum(F.col("n") * F.col("m")).alias("sum"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sum_mm"), F.sum(F.col("n") * F.col("v")).alias("within"),
    )
    k, total = F.col("k"), F.col("total")
    msb = F.try_divide(F.col("sum_mm") - F.try_divide(F.col("sum") * F.col("sum"), total), k - 1)
    msw = F.try_divide(F.col("within"), total - k)
    k0 = F.try_divide(total - F.try_divide(F.col("squares"), total), k - 1)
    value_ = (F.col("msb") - F.col("msw")) / (F.col("msb") + (F.col("k0") - 1) * F.col("msw") + 1e-12)
    full = grand.withColumns({"msb": msb, "msw": msw, "k0": k0})
    return full.select(*by, F.when(k >= 2, value_).otherwise(F.lit(NAN)).alias("icc"))


def _persons(rows: DataFrame, by: Sequence[str], person: str, pred: str, ref: str) -> DataFrame:
    """Count, means and moments of each person of a group: the one shuffle of the rows, of which all but debiased errors follow."""
    p, g = F.col(pred), F.col(ref)
    e = p - g
    return rows.groupBy(*by, F.col(person).alias("_person")).agg(
        F.count("*").cast("double").alias("n"), F.avg(p).alias("p"), F.avg(g).alias("g"), F.var_pop(p).alias("vp"), F.var_pop(g).alias("vg"), F.covar_pop(p, g).alias("vpg"),
        F.avg(e).alias("e"), F.avg(F.abs(e)).alias("abs_e"), F.avg(e * e).alias("ee"), F.min(p).alias("p0"), F.max(p).alias("p1"), F.min(g).alias("g0"), F.max(g).alias("g1"),
    )


def _icc_parts(mean: str, within: str) -> list[Column]:
    """Sums over the persons with two rows or more."""
    some = lambda x: F.sum(F.when(F.col("n") >= 2, x))
    n, m = F.col("n"), F.col(mean)
    return [some(n * m).alias(f"sum_{mean}"), some(n * m * m).alias(f"square_{mean}"), some(n * F.col(within)).alias(f"within_{mean}")]


def _icc_of(mean: str) -> Column:
    k, total = F.col("k"), F.col("total")
    msb = F.try_divide(F.col(f"square_{mean}") - F.try_divide(F.col(f"sum_{mean}") * F.col(f"sum_{mean}"), total), k - 1)
    msw = F.try_divide(F.col(f"within_{mean}"), total - k)
    k0 = F.try_divide(total - F.try_divide(F.col("squares"), total), k - 1)
    return F.when(k >= 2, (msb - msw) / (msb + (k0 - 1) * msw + 1e-12)).otherwise(F.lit(NAN))


def evaluate(pairs: DataFrame, by: Sequence[str], person: str = "person", pred: str = "pred", ref: str = "ref") -> DataFrame:
    """Scalar metrics with the ICC of predictions and, as its ceiling, that of references.

    Rows are aggregated by person once; a second pass takes the debiased absolute error, which needs the mean error of its
    group first.
    """
    keys = [f"_by_{c}" for c in by]  # columns of any name
    rows = eligible(pairs, pred, ref).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(person).alias("_of"), F.col(pred).alias("_p"), F.col(ref).alias("_g"))
    n = F.col("n")
    sums = _persons(rows, keys, "_of", "_p", "_g").groupBy(*keys).agg(
        F.sum("n").alias("rows"), F.count("_person").alias("subjects"), *[F.sum(n * F.col(c)).alias(f"s_{c}") for c in ("p", "g", "e", "abs_e", "ee")],
        F.sum(n * (F.col("vp") + F.col("p") * F.col("p"))).alias("pp"), F.sum(n * (F.col("vg") + F.col("g") * F.col("g"))).alias("gg"), F.sum(n * (F.col("vpg") + F.col("p") * F.col("g"))).alias("pg"),
        ((F.min("p0") < F.max("p1")) & (F.min("g0") < F.max("g1"))).alias("varied"), (F.min("p0") < F.max("p1")).alias("varied_p"), (F.min("g0") < F.max("g1")).alias("varied_g"),
        F.count(F.when(n >= 2, 1)).alias("k"), F.sum(F.when(n >= 2, n)).alias("total"), F.sum(F.when(n >= 2, n * n)).alias("squares"), *_icc_parts("p", "vp"), *_icc_parts("g", "vg"),
    )
    mean = {c: F.col(f"s_{c}") / F.col("rows") for c in ("p", "g", "e", "abs_e", "ee")}
    var = {"p": F.col("pp") / F.col("rows") - mean["p"] * mean["p"], "g": F.col("gg") / F.col("rows") - mean["g"] * mean["g"]}
    std = {c: F.sqrt(F.when(F.col(f"varied_{c}"), F.greatest(v, F.lit(0.0))).otherwise(0.0)) for c, v in var.items()}
    covariance = F.col("pg") / F.col("rows") - mean["p"] * mean["g"]
    cells = sums.select(
        *keys, F.col("rows").cast("long").alias("n"), "subjects", mean["abs_e"].alias("mae"), F.sqrt(mean["ee"]).alias("rmse"),
        F.when(F.col("varied"), F.coalesce(F.try_divide(covariance, std["p"] * std["g"]), F.lit(NAN))).otherwise(F.lit(NAN)).alias("pearson"),
        F.sqrt(F.greatest(mean["ee"] - mean["e"] * mean["e"], F.lit(0.0))).alias("rmse_debiased"), mean["p"].alias("pred_mean"), std["p"].alias("pred_std"), mean["g"].alias("ref_mean"), std["g"].alias("ref_std"),
        mean["e"].alias("bias"), _icc_of("p").alias("icc"), _icc_of("g").alias("icc_ref"),
    )
    named = cells.select(*[F.col(k).alias(f"_in{k}") for k in keys], F.col("bias").alias("_bias"))
    same = [F.col(k).eqNullSafe(F.col(f"_in{k}")) for k in keys]
    debiased = rows.join(named, same).groupBy(*named.columns[:-1]).agg(F.avg(F.abs(F.col("_p") - F.col("_g") - F.col("_bias"))).alias("mae_debiased"))
    out = cells.join(debiased, same)
    columns = ["n", "subjects", "mae", "rmse", "pearson", "mae_debiased", "rmse_debiased", "pred_mean", "pred_std", "ref_mean", "ref_std", "bias", "icc", "icc_ref"]
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *columns)


def summary(pairs: DataFrame, by: Sequence[str], person: str, pred: str = "pred", ref: str = "ref") -> DataFrame:
    """All scalar metrics of each group but the two ICCs."""
    return evaluate(pairs, by, person, pred, ref).drop("icc", "icc_ref")


def evaluated(pairs: DataFrame, by: Sequence[str], order: str, person: str = "person", pred: str = "pred", ref: str = "ref") -> DataFrame:
    """The rows behind the metrics of each group: (by, order, person, pred, ref), one row each and in no array, so that a group
    of any size stays distributed; ``order`` gives their sequence."""
    return eligible(pairs, pred, ref).select(*by, order, F.col(person).alias("person"), F.col(pred).alias("pred"), F.col(ref).alias("ref"))


def complete(metrics: DataFrame, cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every wanted cell; those without an evaluated row have n = 0 and the same columns."""
    return cells.select(*by).distinct().join(metrics, list(by), "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("n", "subjects")})


def run_pairs(preds: DataFrame, sets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows (run, dataset, subset, person, pred, ref and the manifest's other columns) of sessions that a run predicted, an
    evaluation set of it holds (sets may overlap) and the manifest knows.

    ``preds`` is (run, sid, bpm), ``sets`` (run, dataset, subset, sid); a person is a subject of the manifest's dataset.
    """
    known = manifest.withColumns({"person": F.concat_ws(":", "dataset", "subject"), "ref": F.col("gt_rr")}).drop("dataset", "subject", "gt_rr")
    return sets.join(preds.withColumnRenamed("bpm", "pred"), ["run", "sid"]).join(known, "sid")


def run_cells(preds: DataFrame, sets: DataFrame, manifest: DataFrame) -> DataFrame:
    """All metrics of each run on each of its evaluation sets; sets without an evaluated session have n = 0."""
    by = ["run", "dataset", "subset"]
    return complete(evaluate(run_pairs(preds, sets, manifest), by), sets, by)


def run_subgroups(preds: DataFrame, sets: DataFrame, manifest: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Metrics of a cell's subgroups by the column that its dataset is broken down by, where the set has two values of it."""
    columns = SUBGROUP if columns is None else columns
    own = {d: c for d, c in columns.items() if c in manifest.columns}
    value = F.coalesce(*[F.when(F.col("dataset") == d, F.col(c).cast("string")) for d, c in own.items()], F.lit(None).cast("string"))
    label = F.coalesce(*[F.when(F.col("dataset") == d, F.lit(f"{c}=")) for d, c in own.items()], F.lit(None).cast("string"))
    by = ["run", "dataset", "subset"]
    kinds = sets.join(manifest.select("sid", *set(own.values())), "sid").groupBy(*by).agg(F.count_distinct(value).alias("kinds")).where("kinds >= 2").drop("kinds")
    rows = run_pairs(preds, sets, manifest).withColumn("grp", F.concat(label, value)).where(F.col("grp").isNotNull()).join(kinds, by, "left_semi")
    return evaluate(rows, [*by, "grp"])


def cells_and_subgroups(pairs: DataFrame, cell: Sequence[str], subgroup: str) -> DataFrame:
    """Counts and errors of cells and of their subgroups in one pass; subgroups need two values at least in a cell."""
    rows = eligible(pairs).withColumn("e", F.col("pred") - F.col("ref"))
    out = rows.groupingSets([list(map(F.col, cell)), [*map(F.col, cell), F.col(subgroup)]], *cell, subgroup).agg(
        F.grouping(subgroup).alias("whole"), F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.count_distinct(subgroup).alias("values")
    )
    values = out.where("whole = 1").select(*cell, F.col("values").alias("kinds"))
    kept = out.drop("values").join(values, list(cell)).where((F.col("whole") == 1) | ((F.col("kinds") >= 2) & F.col(subgroup).isNotNull()))
    return kept.drop("kinds")


def line_fit(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Least-squares line of predictions over references; groups of one row have none."""
    return eligible(pairs).groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("pred", "ref").alias("slope"), F.regr_intercept("pred", "ref").alias("intercept")).where("n > 1")


def seed_spread(scores: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return scores.groupBy(*by).agg(F.count("*").alias("n_seeds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def best_checkpoint(losses: DataFrame, by: Sequence[str], epoch: str, loss: str) -> DataFrame:
    """The first epoch with the least loss; NaN never wins."""
    best = F.min(F.struct(F.col(loss).alias("loss"), F.col(epoch).alias("epoch"))).alias("best")
    return losses.where(F.col(loss).isNotNull() & ~F.isnan(loss)).groupBy(*by).agg(best).select(*by, F.col("best.epoch").alias("best_epoch"), F.col("best.loss").alias("best_loss"))


def epoch_means(losses: DataFrame, by: Sequence[str], loss: str) -> DataFrame:
    return losses.groupBy(*by).agg(F.avg(loss).alias("mean_loss"), F.count("*").alias("steps"))
