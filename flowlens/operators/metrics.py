"""Detection metrics of scored flows. ``keys`` (without nulls) groups every metric,
for instance by experiment and seed; running sums are distributed either way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import over, rates, ratio
from .ranking import running_sums, shared_table

Y, SCORE = "y_real", "Probability"


def confusion_counts(scored: DataFrame, threshold: Column | float, inclusive: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    hit, y = over(SCORE, threshold, inclusive), F.col(Y) == 1
    return scored.groupBy(*keys).agg(F.count_if(hit & y).alias("TP"), F.count_if(hit & ~y).alias("FP"), F.count_if(~hit & ~y).alias("TN"), F.count_if(~hit & y).alias("FN"))


def curve(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each distinct score: tp, fp here, tps, fps at this score and
    above, and pos, neg in all. Scores are aggregated before anything is ordered."""
    keys = list(keys)
    points = scored.groupBy(*keys, F.col(SCORE).alias("threshold")).agg(F.count_if(F.col(Y) == 1).alias("tp"), F.count_if(F.col(Y) == 0).alias("fp"))
    points = points.withColumn("less", -F.col("threshold"))
    summed = running_sums(points, [*keys, "less"], ["tp", "fp"]).withColumnsRenamed({"cum_tp": "tps", "cum_fp": "fps"}).drop("less")
    if keys:
        # the sums run on over all keys: what came before a key's first score goes off
        own = summed.groupBy(*keys).agg(F.min(F.col("tps") - F.col("tp")).alias("_t"), F.min(F.col("fps") - F.col("fp")).alias("_f"), F.sum("tp").alias("pos"), F.sum("fp").alias("neg"))
        return summed.join(own, keys).withColumns({"tps": F.col("tps") - F.col("_t"), "fps": F.col("fps") - F.col("_f")}).drop("_t", "_f")
    return summed.crossJoin(F.broadcast(points.agg(F.sum("tp").alias("pos"), F.sum("fp").alias("neg"))))


def average_precision(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of recall steps times precision; 0 without positives."""
    p = F.col("tps") / (F.col("tps") + F.col("fps"))
    return points.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("pos") > 0, F.col("tp") / F.col("pos") * p)), F.lit(0.0)).alias("average_precision"))


def roc_auc(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half; 0.5 with one class."""
    # negatives below a score, and half of those at it, for each positive there
    below = F.col("neg") - F.col("fps") + F.col("fp") / 2
    one = (F.max("pos") == 0) | (F.max("neg") == 0)
    return points.groupBy(*keys).agg(F.when(one, 0.5).otherwise(F.sum(F.col("tp") * below) / (F.max("pos").cast("double") * F.max("neg"))).alias("roc_auc"))


def binary_metrics(scored: DataFrame, threshold: Column | float, inclusive: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    keys = list(keys)
    points = curve(scored, keys)
    counts = confusion_counts(scored, threshold, inclusive, keys).withColumns(rates()).withColumn("Total_Flows", F.col("TP") + F.col("FP") + F.col("TN") + F.col("FN"))
    # one class only: average precision 0, area 0.5
    area = points.groupBy(*keys).agg(((F.max("pos") > 0) & (F.max("neg") > 0)).alias("two"))
    parts = [average_precision(points, keys), roc_auc(points, keys), area]
    for part in parts:
        counts = counts.join(part, keys) if keys else counts.crossJoin(part)
    return counts.withColumn("AUC_PR", F.when(F.col("two"), F.col("average_precision")).otherwise(0.0)).withColumnRenamed("roc_auc", "AUC_ROC").drop("two", "average_precision")


def pr_curve(points: DataFrame) -> DataFrame:
    """threshold, precision, recall: one row for each distinct score."""
    return points.select(*[c for c in points.columns if c not in ("tp", "fp", "tps", "fps", "pos", "neg")], (F.col("tps") / (F.col("tps") + F.col("fps"))).alias("precision"), ratio(F.col("tps").cast("double"), F.col("pos")).alias("recall"))


def f1_of(p: Column, r: Column) -> Column:
    return 2 * p * r / (p + r + 1e-10)


def best_threshold_f1(pr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The threshold of the largest F1, the lowest of equals."""
    best = F.max(F.struct(f1_of(F.col("precision"), F.col("recall")).alias("f1"), (-F.col("threshold")).alias("less")))
    return pr.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.less")).alias("threshold"), F.col("b.f1").alias("f1"))


def best_threshold_constrained(pr: DataFrame, floor: float, keys: Sequence[str] = ()) -> DataFrame:
    """The threshold of the largest recall with precision at the floor or above, else that of the largest F1."""
    ok = F.col("precision") >= floor
    some = F.max(F.when(ok, F.struct(F.col("recall").alias("r"), (-F.col("threshold")).alias("less"))))
    best = F.max(F.struct(f1_of(F.col("precision"), F.col("recall")).alias("f1"), (-F.col("threshold")).alias("less")))
    out = pr.groupBy(*keys).agg(some.alias("s"), best.alias("b"))
    return out.select(*keys, F.coalesce(-F.col("s.less"), -F.col("b.less")).alias("threshold"), F.col("s").isNotNull().alias("constrained"))


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Rates at each of a fixed list of thresholds, with the first best F1 marked."""
    one = scored.agg(*[f(t).alias(f"{n}{i}") for i, t in enumerate(thresholds) for n, f in _counts().items()])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(i).alias("i"), *[F.col(f"{n}{i}").alias(n) for n in _counts()]) for i, t in enumerate(thresholds)])).alias("r")).select("r.*").withColumns(rates())
    first = rows.agg(F.max(F.struct("F1", (-F.col("i")).alias("less"))).alias("m")).select((-F.col("m.less")).alias("at"))
    return rows.crossJoin(F.broadcast(first)).withColumn("best", F.col("i") == F.col("at")).drop("i", "at")


def _counts() -> dict:
    y = F.col(Y) == 1
    return {
        "TP": lambda t: F.count_if((F.col(SCORE) >= t) & y),
        "FP": lambda t: F.count_if((F.col(SCORE) >= t) & ~y),
        "TN": lambda t: F.count_if((F.col(SCORE) < t) & ~y),
        "FN": lambda t: F.count_if((F.col(SCORE) < t) & y),
    }


def classification_report(counts: DataFrame) -> DataFrame:
    """From one row of counts: class, precision, recall, f1, support for both
    classes, accuracy, macro and weighted means."""
    c = {k: F.col(k).cast("double") for k in ("TP", "FP", "TN", "FN")}

    def of(name: str, tp: Column, fp: Column, fn: Column) -> Column:
        p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), (tp + fn).alias("support"))

    both = counts.select(of("0", c["TN"], c["FN"], c["FP"]).alias("a"), of("1", c["TP"], c["FP"], c["FN"]).alias("b"), ratio(c["TP"] + c["TN"], c["TP"] + c["FP"] + c["TN"] + c["FN"]).alias("acc"))
    all_ = F.col("a.support") + F.col("b.support")
    mean = lambda n: (F.col(f"a.{n}") + F.col(f"b.{n}")) / 2
    weigh = lambda n: ratio(F.col(f"a.{n}") * F.col("a.support") + F.col(f"b.{n}") * F.col("b.support"), all_)
    row = lambda name, f: F.struct(F.lit(name).alias("class"), *[f(n).alias(n) for n in ("precision", "recall", "f1")], all_.alias("support"))
    rows = F.array(F.col("a"), F.col("b"), row("accuracy", lambda n: F.col("acc")), row("macro avg", mean), row("weighted avg", weigh))
    return both.select(F.explode(rows).alias("r")).select("r.*")


def confusion_matrix(scored: DataFrame, pred: str = "y_pred") -> DataFrame:
    """label, pred_0, pred_1 for both labels, present or not."""
    n = scored.groupBy(F.col(Y).alias("label")).pivot(pred, [0, 1]).agg(F.count(F.lit(1))).toDF("label", "pred_0", "pred_1")
    return scored.sparkSession.range(2).select(F.col("id").cast("int").alias("label")).join(n, "label", "left").fillna(0)


def calibration_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Equal bins of the score, open on the left: mean score and share of positives; empty bins do not occur."""
    # a score on an edge belongs to the bin below it; zero to the first
    edge = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    number = F.size(F.filter(edge, lambda e: e < F.col(SCORE)))
    return scored.groupBy(number.alias("bin")).agg(F.avg(SCORE).alias("mean_score"), F.avg(Y).alias("positive_share"), F.count("*").alias("n"))


def weighted_log_loss(scored: DataFrame, pos_weight: float, logit: str = "logit", window: str = "window_id") -> DataFrame:
    """Mean over windows of the windows' mean loss: softplus without overflow."""
    x, y = F.col(logit), F.col(Y)
    softplus = lambda z: F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    loss = F.lit(pos_weight) * y * softplus(-x) + (1 - y) * softplus(x)
    return scored.groupBy(window).agg(F.avg(loss).alias("loss")).agg(F.avg("loss").alias("loss"))


def mean_score_by_class(scored: DataFrame) -> DataFrame:
    return scored.groupBy(Y).agg(F.avg(SCORE).alias("mean_score"), F.count("*").alias("n"))


def apply_saved_thresholds(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metrics of each (experiment, seed) at its own saved threshold."""
    keys = ["experiment", "seed"]
    joined = scored.join(thresholds, keys)
    return binary_metrics(joined, F.col("optimal_threshold"), keys=keys).join(thresholds, keys)


def counts_above(threshold: Column) -> dict[str, Column]:
    """TP, FP, TN, FN of scores above a threshold, as aggregates over a curve: the sums at
    the lowest score above it are those of all scores above it."""
    over_it = lambda c: F.coalesce(F.max(F.when(F.col("threshold") > threshold, F.col(c))), F.lit(0))
    tp, fp = over_it("tps"), over_it("fps")
    return {"TP": tp, "FP": fp, "TN": F.max("neg") - fp, "FN": F.max("pos") - tp}


def rethreshold(scored: DataFrame, old: DataFrame) -> DataFrame:
    """Per (experiment, seed): the best F1 threshold, the metrics there, and the old metrics
    next to them. All of it is read off one curve, written once: the area does not depend on
    the threshold, and the counts at a threshold stand in the curve."""
    keys = ["experiment", "seed"]
    points = shared_table(curve(scored, keys))
    best = best_threshold_f1(pr_curve(points), keys).select(*keys, F.col("threshold").alias("new"))
    both = best.join(old.select(*keys, F.col("optimal_threshold").alias("old")), keys, "left")
    at = points.join(both, keys)
    p = F.col("tps") / (F.col("tps") + F.col("fps"))
    below = F.col("neg") - F.col("fps") + F.col("fp") / 2
    two = (F.max("pos") > 0) & (F.max("neg") > 0)
    named = {f"{n}_{k}": c for n in ("new", "old") for k, c in counts_above(F.col(n)).items()}
    sums = at.groupBy(*keys).agg(
        F.first("new").alias("optimal_threshold"),
        F.first("old").alias("old_optimal_threshold"),
        F.when(two, F.sum(F.when(F.col("pos") > 0, F.col("tp") / F.col("pos") * p))).otherwise(0.0).alias("AUC_PR"),
        F.when(two, F.try_divide(F.sum(F.col("tp") * below), F.max("pos").cast("double") * F.max("neg"))).otherwise(0.5).alias("AUC_ROC"),
        *[c.alias(k) for k, c in named.items()],
    )
    rate = {n: rates(*(f"{n}_{k}" for k in ("TP", "FP", "TN", "FN"))) for n in ("new", "old")}
    known = F.col("old_optimal_threshold").isNotNull()
    return sums.select(
        *keys, *[F.col(f"new_{k}").alias(k) for k in ("TP", "FP", "TN", "FN")], *[c.alias(k) for k, c in rate["new"].items()],
        (F.col("new_TP") + F.col("new_FP") + F.col("new_TN") + F.col("new_FN")).alias("Total_Flows"), "AUC_ROC", "AUC_PR", "optimal_threshold",
        "old_optimal_threshold", *[F.when(known, rate["old"][k]).alias(f"old_{k}") for k in ("Precision", "Recall", "F1")],
    )


def evaluate_champions(scored: DataFrame, thresholds: DataFrame, champions: DataFrame) -> DataFrame:
    keys = ["experiment", "seed"]
    return apply_saved_thresholds(scored.join(champions.select(*keys), keys, "left_semi"), thresholds)
