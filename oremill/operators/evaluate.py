"""Classification measures at one threshold and at all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.functions.columns import mcc, safe_ratio

from .ranking import prefix_sums


def confusion_counts(df: DataFrame, score: str, label: str, t: float) -> DataFrame:
    """TP, FP, TN, FN for score > t."""
    p, y = F.col(score) > t, F.col(label) == 1
    return df.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"))


def _measures() -> dict[str, Column]:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    prec, rec = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return {"acc": safe_ratio(tp + tn, tp + fp + tn + fn), "prec": prec, "rec": rec, "f1": safe_ratio(2 * prec * rec, prec + rec), "mcc": mcc(tp, fp, tn, fn), "fpr": safe_ratio(fp, fp + tn), "tpr": rec}


def classification_metrics(counts: DataFrame) -> DataFrame:
    """Adds acc, prec, rec, f1 (0 when undefined), mcc (null when undefined), fpr, tpr."""
    return counts.withColumns(_measures())


def threshold_sweep(df: DataFrame, score: str, label: str) -> DataFrame:
    """All measures at each midpoint of neighbouring scores.

    Equal scores are counted first; counts up to each are prefix sums, in as many
    tasks as the session has shuffle partitions.
    """
    g = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    g = prefix_sums(g, ["s"], ["pos", "neg"], leads=["s"]).withColumnsRenamed({"cum_pos": "fn", "cum_neg": "tn", "all_pos": "p", "all_neg": "n", "next_s": "next"})
    cut = g.where("next is not null").select(((F.col("s") + F.col("next")) / 2).alias("t"), (F.col("p") - F.col("fn")).alias("tp"), (F.col("n") - F.col("tn")).alias("fp"), "tn", "fn")
    return classification_metrics(cut)


def roc_points(sweep: DataFrame) -> DataFrame:
    return sweep.select("t", "fpr", "tpr")


def pr_points(sweep: DataFrame) -> DataFrame:
    return sweep.select("t", F.col("rec").alias("recall"), F.col("prec").alias("precision"))


def auc_left_riemann(sweep: DataFrame) -> DataFrame:
    """Area by left rectangles in threshold order, and by trapezoids; end segments are left out."""
    s = prefix_sums(sweep.select("t", "fpr", "tpr"), ["t"], [], leads=["fpr", "tpr"])
    step = F.col("next_fpr") - F.col("fpr")
    s = s.select((step * F.col("tpr")).alias("l"), (step * (F.col("tpr") + F.col("next_tpr")) / 2).alias("z"))
    return s.agg(F.abs(F.sum("l")).alias("auc"), F.abs(F.sum("z")).alias("auc_trapezoid"))


def accuracy(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(pred) == F.col(y)).cast("double")).alias("accuracy"), F.count("*").alias("n"))
