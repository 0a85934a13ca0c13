"""Retrieval and calibration metrics as aggregates over (list, rank, rel) and (p, y) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex.functions.expr import bin_index
from strandex.operators.ranks import numbered

RELEVANT = 2


def _top(k: int, x: Column) -> Column:
    return F.when(F.col("rank") <= k, x)


def list_metrics(rows: DataFrame, keys: list[str], k: int = 10, total: str | None = None) -> DataFrame:
    """All per-list metrics at k. A short list is divided by its own length; the ideal order uses the whole list."""
    w = Window.partitionBy(*keys)
    rel, rank = F.col("rel"), F.col("rank")
    hit = (rel >= RELEVANT).cast("int")
    gain = F.pow(F.lit(2.0), rel.cast("double")) - 1
    rows = rows.withColumn("__ideal", F.row_number().over(w.orderBy(F.desc("rel"), "rank")))
    rows = rows.withColumn("__seen", F.sum(hit).over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found, n = F.sum(_top(k, hit)), F.count(_top(k, F.lit(1)))
    all_hits = F.sum(hit) if total is None else F.max(total)
    first = F.min(F.when(hit == 1, rank))
    dcg = F.coalesce(F.sum(_top(k, gain / F.log2(rank + 1.0))), F.lit(0.0))
    ideal = F.sum(F.when(F.col("__ideal") <= k, gain / F.log2(F.col("__ideal") + 1.0)))
    out = rows.groupBy(*keys).agg(
        F.coalesce(found / n, F.lit(0.0)).alias("precision"),
        F.when(all_hits > 0, F.least(F.lit(1.0), found / all_hits)).otherwise(0.0).alias("recall"),
        dcg.alias("dcg"),
        F.when(ideal > 0, dcg / ideal).otherwise(0.0).alias("ndcg"),
        F.when(F.sum(hit) > 0, F.sum(_top(k, hit * F.col("__seen") / rank)) / F.least(F.sum(hit), F.lit(k))).otherwise(0.0).alias("ap"),
        F.when(first <= k, 1 / first).otherwise(0.0).alias("rr"),
        F.coalesce(F.max(_top(k, hit)), F.lit(0)).alias("hit"),
        F.coalesce(F.avg(_top(k, (rel <= 0).cast("double"))), F.lit(0.0)).alias("bad_rate"),
        F.coalesce(F.avg(_top(k, (rel == 3).cast("double"))), F.lit(0.0)).alias("strong_rate"),
        F.coalesce(F.avg(_top(k, (rel == 1).cast("double"))), F.lit(0.0)).alias("maybe_rate"),
        F.coalesce(F.floor((first - 1) / 10), F.ceil(F.count(F.lit(1)) / 10)).cast("long").alias("clicks"),
        all_hits.alias("__r"),
    )
    in_r = rows.join(out.select(*keys, "__r"), keys).where("rank <= __r").groupBy(*keys).agg((F.sum(hit) / F.first("__r")).alias("r_precision"))
    return out.join(in_r, keys, "left").drop("__r").withColumn("r_precision", F.coalesce("r_precision", F.lit(0.0)))


def mean_metrics(per_list: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    return per_list.groupBy(*by).agg(F.count(F.lit(1)).alias("lists"), *[F.avg(n).alias(n) for n in names])


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins with count, mean prediction, share of positives and their gap; empty bins are kept."""
    spark = rows.sparkSession
    got = rows.groupBy(bin_index(F.col("p"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "rate", F.abs(F.col("mean_p") - F.col("rate")).alias("gap"))


def calibration(rows: DataFrame, bins: int = 10, eps: float = 1e-15) -> DataFrame:
    """One row: expected calibration error, Brier score, log loss, count."""
    r = reliability(rows, bins).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    y, p = F.col("y"), F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("p")))
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))
    return s.crossJoin(F.broadcast(r))


def thresholds(rows: DataFrame, levels=(0.9, 0.8, 0.7, 0.6, 0.5)) -> DataFrame:
    spark = rows.sparkSession
    every = spark.createDataFrame([(float(x),) for x in levels], "threshold double")
    above = F.col("p") >= F.col("threshold")
    g = rows.crossJoin(F.broadcast(every)).groupBy("threshold").agg(F.count(F.when(above, 1)).alias("n"), F.count(F.when(above & (F.col("y") == 1), 1)).alias("positives"), F.sum("y").alias("__all"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return g.select("threshold", "n", "positives", ratio(F.col("positives"), F.col("n")).alias("precision"), ratio(F.col("positives"), F.col("__all")).alias("recall"))


def auc(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Area under the ROC curve; tied scores count half.

    Scores are added up per distinct value first, so ties never meet in one task as rows.
    """
    levels = rows.groupBy(*by, "p").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))
    w = Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    below = levels.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0.0)))
    g = below.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return g.select(*by, F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("u") / (F.col("np") * F.col("nn"))).alias("auc"))


def average_precision(rows: DataFrame) -> DataFrame:
    """Step-wise area under precision and recall, ties taken together."""
    levels = rows.groupBy("p").agg(F.sum("y").cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    run = numbered(levels, [F.desc("p")], "level", {"tp": "pos", "seen": "n"})
    return run.agg((F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.sum("pos")).alias("average_precision"))


def operating_points(rows: DataFrame) -> DataFrame:
    """Best recall where precision is at least 0.8, and best precision where recall is at least 0.8."""
    levels = rows.groupBy("p").agg(F.sum("y").cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    total = levels.agg(F.sum("pos").alias("all"))
    run = numbered(levels, [F.desc("p")], "level", {"tp": "pos", "seen": "n"}).crossJoin(F.broadcast(total))
    run = run.withColumn("precision", F.col("tp") / F.col("seen")).withColumn("recall", F.col("tp") / F.col("all"))
    return run.agg(F.max(F.when(F.col("precision") >= 0.8, F.col("recall"))).alias("recall_at_precision"), F.max(F.when(F.col("recall") >= 0.8, F.col("precision"))).alias("precision_at_recall"))


def quantiles(rows: DataFrame, column: str, at=(0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)) -> DataFrame:
    points = rows.agg(F.percentile(column, F.array(*[F.lit(float(q)) for q in at])).alias("v"))
    return points.select(F.posexplode("v").alias("i", "value")).select(F.element_at(F.array(*[F.lit(float(q)) for q in at]), F.col("i") + 1).alias("quantile"), "value")


def judged_gate(labels: DataFrame) -> DataFrame:
    """One row: distinct judged pairs and seeds, ratings, and how far the amount carries."""
    g = labels.dropDuplicates(["seed", "cand", "source"]).agg(F.count(F.lit(1)).alias("labels"), F.count_distinct("seed").alias("seeds"), F.sum((F.col("rating") >= RELEVANT).cast("int")).alias("positive"))
    n = F.col("labels")
    return g.withColumn("status", F.when(n < 50, "insufficient").when(n < 200, "diagnostics").when(n < 500, "candidate_profile").otherwise("default_review"))
