"""Comparison of experiment runs, histories and thresholds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import base_model_name

METRICS = ("Precision", "Recall", "F1", "F2", "AUC-PR", "AUC-ROC")


def display_names(runs: DataFrame, names: DataFrame, column: str = "model_name") -> DataFrame:
    """Adds Model: the display name of the text before _seed, or that text itself."""
    base = base_model_name(column)
    mapped = runs.withColumn("_base", base).join(names.toDF("_base", "_name"), "_base", "left")
    return mapped.withColumn("Model", F.coalesce("_name", "_base")).drop("_base", "_name")


def gather_metrics(histories: DataFrame, logs: DataFrame) -> DataFrame:
    """Architecture, Raw_Dir_Name, Seed, F1_Score, Best_Epoch, Optimal_Threshold of each seed in both."""
    h = histories.select(F.col("experiment").alias("Raw_Dir_Name"), F.col("seed").alias("Seed"), F.col("early_stopping.best_epoch").alias("Best_Epoch"))
    g = logs.select(F.col("experiment").alias("Raw_Dir_Name"), F.col("seed").alias("Seed"), F.col("Model").alias("Architecture"), F.col("f1").alias("F1_Score"), F.coalesce("optimal_threshold", F.lit(0.5)).alias("Optimal_Threshold"))
    return g.join(h, ["Raw_Dir_Name", "Seed"])


def champions_1sd(runs: DataFrame, by: str = "Architecture") -> DataFrame:
    """Of the runs within one sample deviation of the architecture's best F1, the
    one with fewest epochs, then the highest F1, then the smallest seed."""
    best = runs.groupBy(by).agg((F.max("F1_Score") - F.coalesce(F.stddev_samp("F1_Score"), F.lit(0.0))).alias("floor"))
    near = runs.join(best, by).where("F1_Score >= floor")
    pick = F.min(F.struct("Best_Epoch", (-F.col("F1_Score")).alias("less"), "Seed"))
    return near.groupBy(by, "floor").agg(pick.alias("c")).select(by, F.col("c.Seed").alias("Seed"), (-F.col("c.less")).alias("F1_Score"), F.col("c.Best_Epoch").alias("Best_Epoch"), "floor")


def summary_mean_std(runs: DataFrame, order: DataFrame, metrics: Sequence[str], by: str = "Architecture") -> DataFrame:
    """Mean and sample deviation by model in the order of ``order`` (model, pos); models without runs keep nulls."""
    stats = runs.groupBy(by).agg(*[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))], F.count("*").alias("runs"))
    return order.join(stats, by, "left").withColumn("runs", F.coalesce("runs", F.lit(0)))


def metrics_long(runs: DataFrame, metrics: Sequence[str], by: str = "Architecture") -> DataFrame:
    """metric, mean, std, n for each model and metric, from the melted table."""
    long = runs.unpivot([by], list(metrics), "metric", "value")
    return long.groupBy(by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n"))


def metrics_mean(runs: DataFrame, metrics: Sequence[str], by: str = "Architecture") -> DataFrame:
    return runs.groupBy(by).agg(*[F.avg(m).alias(m) for m in metrics])


def history_rows(histories: DataFrame) -> DataFrame:
    """experiment, seed, best_epoch, epoch, train_loss, val_loss: a row for each epoch."""
    z = F.posexplode(F.arrays_zip(F.col("training.train_loss").alias("train_loss"), F.col("training.val_loss").alias("val_loss"))).alias("epoch", "z")
    return histories.select("experiment", "seed", F.col("early_stopping.best_epoch").alias("best_epoch"), z).select("experiment", "seed", "best_epoch", "epoch", "z.*")


def loss_curve(rows: DataFrame, value: str = "train_loss") -> DataFrame:
    """experiment, epoch, mean, std (population), seeds, up to the shortest seed."""
    short = rows.groupBy("experiment", "seed").agg(F.count("*").alias("n")).groupBy("experiment").agg(F.min("n").alias("shortest"))
    out = rows.join(short, "experiment").where("epoch < shortest")
    return out.groupBy("experiment", "epoch").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("seeds"))


def last_stop(low: float, high: float, patience: int = 10, min_delta: float = 1e-4) -> int:
    """The last epoch at which ``early_stop_replay`` can stop on values from low to
    high: each better value rises by min_delta, and comes within ``patience`` epochs."""
    return patience * (int((high - low) / min_delta) + 2)


def loss_by_seed(rows: DataFrame) -> DataFrame:
    """experiment, seed, epoch, train_loss, val_loss, is_best: the best epoch is the history's own."""
    return rows.select("experiment", "seed", "epoch", "train_loss", "val_loss", (F.col("epoch") == F.col("best_epoch")).alias("is_best"))


def early_stop_replay(histories: DataFrame, values: str = "training.val_aucpr", patience: int = 10, min_delta: float = 1e-4, mode: str = "max") -> DataFrame:
    """experiment, seed, best_epoch, best_value, stopped_epoch: a value counts as
    better only by min_delta; after ``patience`` epochs without one training stops."""
    start = F.struct(F.lit(-1).alias("best_epoch"), F.lit(None).cast("double").alias("best"), F.lit(0).alias("wait"), F.lit(-1).alias("stop"), F.lit(0).alias("i"))

    def step(a: Column, v: Column) -> Column:
        better = a["best"].isNull() | ((v > a["best"] + min_delta) if mode == "max" else (v < a["best"] - min_delta))
        wait = F.when(better, 0).otherwise(a["wait"] + 1)
        grown = F.struct(
            F.when(better, a["i"]).otherwise(a["best_epoch"]).alias("best_epoch"), F.when(better, v).otherwise(a["best"]).alias("best"), wait.alias("wait"),
            F.when(wait >= patience, a["i"]).otherwise(-1).alias("stop"), (a["i"] + 1).alias("i"),
        )
        return F.when(a["stop"] >= 0, a).otherwise(grown)

    out = histories.select("experiment", "seed", F.aggregate(F.col(values).cast("array<double>"), start, step).alias("a"))
    return out.select("experiment", "seed", F.col("a.best_epoch").alias("best_epoch"), F.col("a.best").alias("best_value"), F.when(F.col("a.stop") >= 0, F.col("a.stop")).alias("stopped_epoch"))


def pending_experiments(planned: DataFrame, logged: DataFrame, keys: Sequence[str] = ("experiment", "seed")) -> DataFrame:
    return planned.join(logged.select(*keys).distinct(), list(keys), "left_anti")


def run_summary(runs: DataFrame, metrics: Sequence[str], by: str = "experiment") -> DataFrame:
    """Mean and sample deviation by exact experiment key."""
    return runs.groupBy(by).agg(F.count("*").alias("runs"), *[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))])


def normalise_runs(configs: DataFrame, metrics: Mapping[str, str]) -> DataFrame:
    """Run-log rows from JSON configs: hp, data and extra become maps with prefixed
    keys; the time comes from run_ts (yyyyMMdd_HHmmss at UTC-3), else it is now.
    ``configs`` has run_id, model_name, type, run_ts, hp, data, extra, metrics (JSON texts)."""

    def prefixed(c: str) -> Column:
        return F.transform_keys(F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit(f"{c}_"), k)).alias(c)

    ts = F.try_to_timestamp(F.concat("run_ts", F.lit("-03:00")), F.lit("yyyyMMdd_HHmmssXXX"))
    m = F.from_json("metrics", "map<string,double>")
    return configs.select(
        F.coalesce(ts, F.current_timestamp()).alias("timestamp"), "run_ts", "run_id", "model_name", "type",
        *[prefixed(c) for c in ("hp", "data", "extra")], *[F.try_element_at(m, F.lit(k)).alias(v) for k, v in metrics.items()],
    )


def first_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
