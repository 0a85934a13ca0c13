"""Classifier scores: coverage reports, label suggestions, folds, training and batch scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex.functions.expr import score_bucket, tie_token
from strandex.runtime import stage

MODES = ("uncertainty", "hard_negative", "diversity", "disagreement", "high_impact_unlabeled")


def coverage(scores: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per classifier: how many items are scored, of how many, and how scores fall into buckets."""
    total = tracks.agg(F.count(F.lit(1)).alias("total"))
    g = scores.withColumn("bucket", score_bucket(F.col("score"))).groupBy("classifier_key")
    n = g.agg(F.count(F.lit(1)).alias("scored"), *[F.count(F.when(F.col("bucket") == b, 1)).alias(b) for b in ("low", "medium", "high")])
    return n.crossJoin(F.broadcast(total)).withColumn("coverage", F.col("scored") / F.col("total"))


def feedback_totals(feedback: DataFrame, item: str = "cand") -> DataFrame:
    return feedback.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("rating") >= 2, 1)).alias("positive"), F.count(F.when(F.col("rating") <= 1, 1)).alias("negative"), F.avg("rating").alias("mean"))


def suggestion_order(mode: str, score: Column, feedback_n: Column, feedback_mean: Column) -> Column:
    """Lower comes first."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    n = F.coalesce(feedback_n, F.lit(0))
    return {
        "uncertainty": F.abs(score - 0.5),
        "hard_negative": -score + F.when(F.coalesce(feedback_mean, F.lit(3.0)) <= 1, -1.0).otherwise(0.0),
        "diversity": F.pmod(F.floor(score * 10), F.lit(10)).cast("double"),
        "disagreement": -F.abs(score - F.coalesce(feedback_mean / 3, score)),
        "high_impact_unlabeled": F.when(n > 0, 1.0).otherwise(0.0) - score,
    }[mode]


def suggestions(scores: DataFrame, feedback: DataFrame, mode: str, limit: int = 25, seed: int = 123, key: str = "track_id") -> DataFrame:
    """Items to label next, ranked; ties by a hash of the seed and the item."""
    f = feedback.withColumnRenamed("cand", key)
    j = scores.join(f, key, "left")
    j = j.withColumn("order_by", F.round(suggestion_order(mode, F.col("score"), F.col("n"), F.col("mean")), 9)).withColumn("tie", tie_token(seed, mode, F.col(key)))
    top = j.orderBy("order_by", "tie").limit(limit)
    return top.select(key, "score", F.row_number().over(Window.orderBy("order_by", "tie")).alias("rank"))


def folds(rows: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified folds: items of a label in hash order, dealt round."""
    w = Window.partitionBy(label).orderBy(tie_token(seed, F.col(key)), key)
    return rows.withColumn("fold", (F.row_number().over(w) - 1) % k)


def train_logistic(rows: DataFrame, columns: list[str], label: str, seed: int = 42):
    """A standardised logistic regression with balanced classes; rows with a missing value are skipped."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.coalesce(*[F.when(F.col(label) == v, F.lit(total / (len(counts) * n))) for v, n in counts.items()])
    stages = [VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, weightCol="w", maxIter=50, regParam=0.01)]
    return Pipeline(stages=stages).fit(rows.withColumn("w", weight))


def score_with(model, rows: DataFrame, key: str, *keep: str) -> DataFrame:
    """(key, score, confidence, predicted, bucket) of every complete row, and the columns to keep."""
    from pyspark.ml.functions import vector_to_array

    p = model.transform(rows.withColumn("w", F.lit(1.0))).select(key, *keep, vector_to_array("probability")[1].alias("score"))
    return p.select(key, "score", F.greatest("score", 1 - F.col("score")).alias("confidence"), (F.col("score") >= 0.5).cast("int").alias("predicted"), score_bucket(F.col("score")).alias("bucket"), *keep)


def cross_validated(rows: DataFrame, columns: list[str], label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(key, score, confidence, predicted, bucket, label, fold): each row scored by the model of the other folds."""
    dealt = stage(folds(rows, label, key, k, seed), "folds")
    scored = [score_with(train_logistic(dealt.where(F.col("fold") != i), columns, label), dealt.where(F.col("fold") == i), key, label, "fold") for i in range(k)]
    return reduce(DataFrame.unionAll, scored)


def fold_summary(scored: DataFrame, label: str) -> DataFrame:
    """(metric, mean, std) of the folds' metrics; the deviation is that of the population."""
    each = confusion(scored, label, "predicted", ["fold"])
    names = ("accuracy", "precision", "recall", "macro_f1")
    long = each.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("x")) for n in names])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count(F.lit(1)).alias("folds"))


def confusion(rows: DataFrame, truth: str, predicted: str, by: list[str] = ()) -> DataFrame:
    """One row (or one a group): accuracy, precision, recall and macro F1 of a binary prediction."""
    t, p = F.col(truth), F.col(predicted)
    c = lambda cond: F.count(F.when(cond, 1)).cast("double")
    s = rows.groupBy(*by).agg(c((t == 1) & (p == 1)).alias("tp"), c((t == 0) & (p == 1)).alias("fp"), c((t == 1) & (p == 0)).alias("fn"), c((t == 0) & (p == 0)).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f1 = lambda a, b, d: ratio(2 * a, 2 * a + b + d)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return s.select(*by, ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ((f1(tp, fp, fn) + f1(tn, fn, fp)) / 2).alias("macro_f1"))
