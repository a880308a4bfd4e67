"""Evaluation (E1-E8): curves, AUC, thresholds, confusion and reports.

Everything starts from one pre-aggregation per distinct score
(positives, negatives), followed by bucketed running sums (R1), so the
curves are exact and never need a single-partition sort of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.operators.rank import global_cumsum, global_rank


def _big(c: str) -> Column:
    """A count as a decimal whose products cannot overflow (19 digits each)."""
    return F.col(c).cast("decimal(19,0)")


def _auc(p: str, n: str) -> Column:
    return F.try_divide(F.col("_num"), (_big(p) * _big(n)).cast("double") * 2).alias("auc")


def _score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    y = F.col(label).cast("int")
    return df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum(y).cast("bigint").alias("pos"), F.sum(1 - y).cast("bigint").alias("neg"))


def roc_table(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Per distinct score (high to low): tps, fps and class totals P, N."""
    c = _score_counts(df, score, label)
    cum = global_cumsum(c, ["threshold"], ["pos", "neg"], descending=True, total_prefix="tot_")
    return cum.select("threshold", "pos", "neg", F.col("cum_pos").alias("tps"), F.col("cum_neg").alias("fps"),
                      F.col("tot_pos").alias("P"), F.col("tot_neg").alias("N"))


def _corners(t: DataFrame) -> DataFrame:
    """Points whose step (new positives, new negatives) is no copy of the next one's; the last point stays.

    Each distinct score has one row; the next score's step comes from a join on
    the global rank, so no task holds the whole curve.
    """
    r = global_rank(t, ["threshold"], descending=True, out="_r")
    nxt = r.select((F.col("_r") - 1).alias("_r"), F.col("pos").alias("_np"), F.col("neg").alias("_nn"))
    j = r.join(nxt, "_r", "left")
    return j.where(F.col("_np").isNull() | (F.col("pos") != F.col("_np")) | (F.col("neg") != F.col("_nn"))).drop("_r", "_np", "_nn")


def roc_curve(df: DataFrame, score: str = "score", label: str = "label", drop_collinear: bool = False) -> DataFrame:
    """(threshold, fpr, tpr, tps, fps), starting at threshold +inf, (0, 0).

    One point per distinct score. ``drop_collinear`` leaves out points on the
    line between their neighbours (the default of the usual ROC libraries):
    a point stays if the step to it or the one after it changes direction.
    A class without rows has a null rate.
    """
    t = roc_table(df, score, label)
    if drop_collinear:
        t = _corners(t)
    pts = t.select("threshold", "tps", "fps", "P", "N")
    tot = t.groupBy("P", "N").agg(F.lit(float("inf")).alias("threshold"))
    first = tot.select("threshold", F.lit(0).cast("bigint").alias("tps"), F.lit(0).cast("bigint").alias("fps"),
                       "P", "N")
    allp = pts.unionByName(first)
    return allp.select("threshold", F.try_divide("fps", "N").alias("fpr"), F.try_divide("tps", "P").alias("tpr"), "tps", "fps")


def youden(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Threshold maximising TPR - FPR; ties -> the highest threshold.

    J is compared exactly as tps N - fps P (decimals of 38 digits). If no
    point beats J = 0 the answer is +inf (predict no positive). With one class
    only every J is 0 and the rate of the other class is null.
    """
    t = roc_table(df, score, label)
    pts = t.select("threshold", "tps", "fps", "P", "N").unionByName(
        t.groupBy("P", "N").agg(F.lit(float("inf")).alias("threshold"))
         .select("threshold", F.lit(0).cast("bigint").alias("tps"), F.lit(0).cast("bigint").alias("fps"), "P", "N"))
    jn = _big("tps") * _big("N") - _big("fps") * _big("P")
    best = pts.groupBy("P", "N").agg(F.max_by(F.struct("threshold", "tps", "fps"),
                                              F.struct(jn, F.col("threshold"))).alias("b"))
    return best.select(F.col("b.threshold").alias("threshold"),
                       (F.try_divide("b.tps", "P") - F.try_divide("b.fps", "N")).alias("j"),
                       F.try_divide("b.tps", "P").alias("tpr"), F.try_divide("b.fps", "N").alias("fpr"))


def pr_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, precision, recall) from the highest score down to the
    first threshold reaching full recall, plus the end point (1, 0, null).
    Without positives recall is null at every score."""
    t = roc_table(df, score, label)
    body = t.where((F.col("tps") - F.col("pos") < F.col("P")) | (F.col("P") == 0)).select(
        "threshold", (F.col("tps") / (F.col("tps") + F.col("fps"))).alias("precision"),
        F.try_divide("tps", "P").alias("recall"))
    end = t.groupBy("P").agg(F.lit(None).cast("double").alias("threshold")).select(
        "threshold", F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return body.unionByName(end)


def auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """ROC AUC with ties counted half: sum pos (2 neg_below + neg) / (2 P N),
    the numerator an exact integer (38 digits). Null with one class only."""
    t = roc_table(df, score, label)
    num = F.sum(_big("pos") * (2 * (_big("N") - _big("fps")) + _big("neg")))
    return t.groupBy("P", "N").agg(num.cast("double").alias("_num")).select(_auc("P", "N"))


def confusion_counts(df: DataFrame, label: str, pred: Column) -> DataFrame:
    y = F.col(label).cast("int")
    p = pred.cast("int")
    return df.agg(F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).cast("bigint").alias("tp"),
                  F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).cast("bigint").alias("fp"),
                  F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).cast("bigint").alias("fn"),
                  F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0)).cast("bigint").alias("tn"))


def _ratio(n, d):
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def metrics_from_counts(c: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and balanced accuracy; 0/0 -> 0."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    rec = _ratio(tp, tp + fn)
    spec = _ratio(tn, tn + fp)
    return c.select("tp", "fp", "fn", "tn",
                    F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    _ratio(tp, tp + fp).alias("precision"), rec.alias("recall"),
                    _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
                    ((rec + spec) / 2).alias("balanced_accuracy"))


def apply_threshold(score: Column, threshold, strict: bool = False) -> Column:
    """E5: ``score >= t`` (tuned threshold) or ``score > t`` (default 0.5)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(score > t if strict else score >= t, 1).otherwise(0)


def threshold_metrics(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """E5+E6 at the Youden threshold (>=) and at the default 0.5 (>)."""
    t = youden(df, score, label).select("threshold").scalar()
    s = F.col(score).cast("double")
    a = metrics_from_counts(confusion_counts(df, label, apply_threshold(s, t))) \
        .select(F.lit("youden").alias("rule"), t.alias("threshold"), "*")
    b = metrics_from_counts(confusion_counts(df, label, apply_threshold(s, 0.5, strict=True))) \
        .select(F.lit("default").alias("rule"), F.lit(0.5).alias("threshold"), "*")
    return a.unionByName(b)


def confusion_matrix(df: DataFrame, label: str, pred: Column) -> DataFrame:
    """(actual, predicted, n), all four cells kept (zeros too)."""
    c = confusion_counts(df, label, pred)
    cells = [(1, 1, "tp"), (0, 1, "fp"), (1, 0, "fn"), (0, 0, "tn")]
    return c.select(F.explode(F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                                                 F.col(n).alias("n")) for a, p, n in cells])).alias("s")) \
        .select("s.*")


def classification_report(df: DataFrame, label: str, pred: Column) -> DataFrame:
    """Per-class precision, recall, F1, support; accuracy; macro and
    weighted means (F1 as 2tp / (2tp + fp + fn))."""
    c = confusion_counts(df, label, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1, f1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    m = c.select(p0.alias("p0"), r0.alias("r0"), f0.alias("f0"), s0.alias("s0"),
                 p1.alias("p1"), r1.alias("r1"), f1.alias("f1"), s1.alias("s1"),
                 ((tp + tn) / n).alias("acc"), n.alias("n"))

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        s.cast("bigint").alias("support"))
    P0, R0, F0, S0, P1, R1, F1_, S1, ACC, N = (F.col(x) for x in
                                               ("p0", "r0", "f0", "s0", "p1", "r1", "f1", "s1", "acc", "n"))
    rows = [row("0", P0, R0, F0, S0), row("1", P1, R1, F1_, S1),
            row("accuracy", F.lit(None), F.lit(None), ACC, N),
            row("macro avg", (P0 + P1) / 2, (R0 + R1) / 2, (F0 + F1_) / 2, N),
            row("weighted avg", (P0 * S0 + P1 * S1) / N, (R0 * S0 + R1 * S1) / N, (F0 * S0 + F1_ * S1) / N, N)]
    return m.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def auc_by(df: DataFrame, score: str, label: str, group_cols) -> DataFrame:
    """E4 per group (folds, grid points): one bucketed running sum for all groups."""
    g = list(group_cols)
    y = F.col(label).cast("int")
    c = df.groupBy(*g, F.col(score).cast("double").alias("threshold")).agg(
        F.sum(y).cast("bigint").alias("pos"), F.sum(1 - y).cast("bigint").alias("neg"))
    cum = global_cumsum(c, ["threshold"], ["pos", "neg"], group_cols=g, descending=True, total_prefix="tot_")
    num = F.sum(_big("pos") * (2 * (_big("tot_neg") - _big("cum_neg")) + _big("neg")))
    return cum.groupBy(*g, "tot_pos", "tot_neg").agg(num.cast("double").alias("_num")).select(*g, _auc("tot_pos", "tot_neg"))


def curve_metrics(df: DataFrame, score: str, label: str, group_cols=()) -> DataFrame:
    """E2, E4 and E6 per group from one running sum: AUC, the Youden threshold, and the counts and rates at it.

    At a point of the curve the positives so far are the true positives of its
    threshold and the negatives so far the false ones, so the scores are read
    once. The threshold is +inf where no point beats J = 0 (see ``youden``).
    """
    g = list(group_cols)
    y = F.col(label).cast("int")
    c = df.groupBy(*g, F.col(score).cast("double").alias("threshold")).agg(F.sum(y).cast("bigint").alias("pos"), F.sum(1 - y).cast("bigint").alias("neg"))
    t = global_cumsum(c, ["threshold"], ["pos", "neg"], group_cols=g, descending=True, total_prefix="tot_")
    j = _big("cum_pos") * _big("tot_neg") - _big("cum_neg") * _big("tot_pos")
    num = F.sum(_big("pos") * (2 * (_big("tot_neg") - _big("cum_neg")) + _big("neg")))
    best = t.groupBy(*g, F.col("tot_pos").alias("P"), F.col("tot_neg").alias("N")).agg(
        num.cast("double").alias("_num"), F.max(j).alias("_j"), F.max_by(F.struct("threshold", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp")), F.struct(j, F.col("threshold"))).alias("b"))
    found = F.col("_j") > 0
    at = best.select(*g, _auc("P", "N"), F.when(found, F.col("b.threshold")).otherwise(float("inf")).alias("threshold"),
                     *[F.when(found, F.col(f"b.{x}")).otherwise(0).cast("bigint").alias(x) for x in ("tp", "fp")], "P", "N")
    at = at.withColumn("fn", F.col("P") - F.col("tp")).withColumn("tn", F.col("N") - F.col("fp"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return at.select(*g, "auc", "threshold", "tp", "fp", "fn", "tn", F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                     _ratio(tp, tp + fn).alias("recall"), _ratio(tp, tp + fp).alias("precision"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
