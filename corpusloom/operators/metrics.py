"""Evaluation figures. Class metrics come from one confusion count, so their cost after the
first aggregation depends on the number of classes only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import running_totals


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or there are no rows."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b2 = beta * beta
    return safe_ratio((1 + b2) * precision * recall, b2 * precision + recall)


def confusion(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    return df.groupBy(F.col(predicted).alias("predicted"), F.col(actual).alias("actual")).agg(
        F.count(F.lit(1)).alias("n")
    )


def label_metrics(df: DataFrame, predicted: str, actual: str, beta: float = 1.0) -> DataFrame:
    """(label, tp, n_predicted, n_actual, precision, recall, f_score), one row per label."""
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("predicted").alias("label"),
            F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(zero).alias("tp"),
            F.col("n").alias("n_predicted"),
            zero.alias("n_actual"),
        ),
        F.struct(
            F.col("actual").alias("label"), zero.alias("tp"), zero.alias("n_predicted"), F.col("n").alias("n_actual")
        ),
    )
    counts = (
        confusion(df, predicted, actual)
        .select(F.inline(sides))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "n_predicted", "n_actual")])
    )
    rated = counts.withColumn("precision", safe_ratio(F.col("tp"), F.col("n_predicted"))).withColumn(
        "recall", safe_ratio(F.col("tp"), F.col("n_actual"))
    )
    return rated.withColumn("f_score", f_beta(F.col("precision"), F.col("recall"), beta))


def accuracy(predicted: Column, actual: Column) -> Column:
    """Aggregate: share of matches, 0 without rows."""
    return F.coalesce(F.avg((predicted == actual).cast("double")), F.lit(0.0))


def binary_metrics(df: DataFrame, predicted: str, actual: str, positive=1, beta: float = 1.0) -> DataFrame:
    """One row: accuracy, precision, recall, f_score of one positive label."""
    p, t = F.col(predicted) == F.lit(positive), F.col(actual) == F.lit(positive)
    sums = df.agg(
        accuracy(F.col(predicted), F.col(actual)).alias("accuracy"),
        F.count_if(p & t).alias("_tp"),
        F.count_if(p).alias("_p"),
        F.count_if(t).alias("_t"),
    )
    rated = sums.select(
        "accuracy",
        safe_ratio(F.col("_tp"), F.col("_p")).alias("precision"),
        safe_ratio(F.col("_tp"), F.col("_t")).alias("recall"),
    )
    return rated.withColumn("f_score", f_beta(F.col("precision"), F.col("recall"), beta))


def macro_metrics(df: DataFrame, predicted: str, actual: str, beta: float = 1.0) -> DataFrame:
    """One row: accuracy and the unweighted means of the label metrics."""
    labels = label_metrics(df, predicted, actual, beta)
    return labels.agg(
        safe_ratio(F.sum("tp"), F.sum("n_actual")).alias("accuracy"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f_score")],
    )


def auc(df: DataFrame, score: str, actual: str, positive=1) -> DataFrame:
    """Area under the ROC curve: share of (positive, negative) pairs in the right order, equal
    scores counting half. From the counts per distinct score and their running total."""
    hit = F.col(actual) == F.lit(positive)
    by_score = df.groupBy(F.col(score).alias("_score")).agg(
        F.count_if(hit).alias("_pos"), F.count_if(~hit).alias("_neg")
    )
    ranked = running_totals(by_score, ["_score"], {"_neg_to": "_neg"})
    pairs = F.sum(F.col("_pos") * (2 * F.col("_neg_to") - F.col("_neg")))
    return ranked.agg(safe_ratio(pairs, 2 * F.sum("_pos") * F.sum("_neg")).alias("auc"))


def weighted_metrics(df: DataFrame, predicted: str, actual: str, weight: str, loss: str) -> DataFrame:
    """Weighted figures of 0/1 predictions; rows of weight 0 (padding) do not count.

    The area is taken on the predictions themselves: one corner point, (1 + TPR - FPR) / 2.
    """
    w, p, t = F.col(weight), F.col(predicted) == 1, F.col(actual) == 1

    def mass(cond: Column) -> Column:
        return F.sum(F.when(cond, w).otherwise(0.0))

    sums = df.agg(
        F.sum(w).alias("w"), F.sum(w * F.col(loss)).alias("loss"), mass(p == t).alias("right"),
        mass(p & t).alias("tp"), mass(p).alias("p"), mass(t).alias("t"), mass(p & ~t).alias("fp"),
        mass(~t).alias("neg"),
    )
    c = F.col
    return sums.select(
        safe_ratio(c("loss"), c("w")).alias("eval_loss"),
        safe_ratio(c("right"), c("w")).alias("eval_accuracy"),
        ((1 + safe_ratio(c("tp"), c("t")) - safe_ratio(c("fp"), c("neg"))) / 2).alias("eval_auc"),
        safe_ratio(c("tp"), c("p")).alias("eval_precision"),
        safe_ratio(c("tp"), c("t")).alias("eval_recall"),
    )


def masked_loss(loss: Column, weight: Column) -> Column:
    """Aggregate: weighted mean with 1e-5 added to the weight."""
    return F.sum(loss * weight) / (F.sum(weight) + F.lit(1e-5))


def token_weighted_loss(loss: Column, tokens: Column) -> Column:
    """Aggregate: total loss per token, 0 without tokens."""
    return safe_ratio(F.sum(loss), F.sum(tokens))


def running_means(df: DataFrame, epoch: str, step: str, loss: str, correct: str, size: str) -> DataFrame:
    """Mean loss and percent correct up to each step of its epoch."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    totals = {"_loss": loss, "_correct": correct, "_size": size, "_steps": "_one"}
    summed = running_totals(ones, [step], totals, by=[epoch])
    return summed.select(
        epoch,
        step,
        (F.col("_loss") / F.col("_steps")).alias("mean_loss"),
        safe_ratio(F.col("_correct") * 100, F.col("_size")).alias("percent_correct"),
    )


def key_value_lines(row: DataFrame) -> DataFrame:
    """A one-row result as ``key = value`` lines in key order."""
    pairs = F.array_sort(
        F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in row.columns])
    )
    return row.select(F.inline(pairs)).select(
        F.concat(F.col("key"), F.lit(" = "), F.col("value")).alias("line")
    )
