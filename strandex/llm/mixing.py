"""Mix sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document gets an exponential key ``-ln(u) / w``: ``u`` is a hash of its id and text, ``w`` its
quality weight. Within a source the smallest keys are taken until the token budget is met. A budget
above the source's size is spent on complete epochs first; only the remainder is selected by key.

The prefix sums run in two levels, so that a source holding most of the rows is never in one task:
sizes are summed per (source, key bucket), the running sum over buckets finds the one bucket where a
source's budget ends, and only that bucket's documents are ordered exactly.

Defined results: null text counts as empty (size 0, nothing taken); a null source is a source of its
own, ordered last; documents without words take 0; rows equal in id and text share one fate; an
empty table gives an empty result; input columns are kept by :func:`mix_rows`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex.runtime import fresh, stage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>!]"
WEIGHT_CYCLE = (1, 2, 3)
MAX_EPOCHS = 3
BUCKETS = 4096


def doc_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose, falling as symbols become frequent among the words."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(SYMBOL)), F.lit(0))
    return 1.0 / (1.0 + 4.0 * (symbols.cast("double") / F.greatest(size, F.lit(1)).cast("double")))


def _row_hash(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text.cast("binary")), F.lit(""))))


def bucket_of(key: Column) -> Column:
    """Buckets in the order of keys. Their steps widen with the key, so that low weights do not pile up in the last one."""
    return F.floor(key / (1.0 + key) * BUCKETS).cast("int")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size, h, key, bucket): what sampling needs to know of each document."""
    size = doc_size(F.col(text))
    out = docs.select(
        F.col(doc_id).alias("id"),
        F.col(source).cast("string").alias("src"),
        size.alias("size"),
        quality_weight(F.col(text), size).alias("w"),
        _row_hash(F.col(doc_id), F.col(text)).alias("h"),
    )
    u = (F.conv(F.substring("h", 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))
    out = out.withColumn("key", -F.log(u) / F.col("w")).drop("w")
    return out.withColumn("bucket", bucket_of(F.col("key")))


def targets(sizes: DataFrame, weight_cycle: tuple[int, ...] = WEIGHT_CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(src, source_size) -> adds weight, target, epochs and rest.

    The weights share out the sum of all sizes; a target stops at ``max_epochs`` times its source's
    size and the excess goes to the others by weight. With the sources in order of cap / weight the
    capped ones come first, so one pass of running sums finds the common level.
    """
    ranked = sizes.withColumn("pos", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())))
    cycle = F.array(*[F.lit(int(w)) for w in weight_cycle])
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("pos") - 1) % len(weight_cycle) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs)
    ranked = ranked.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    every = Window.orderBy("ratio", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("ratio", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.sum("cap").over(upto) + F.col("cap")).cast("double")
        / (F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight")).cast("double"),
    )
    ranked = ranked.withColumn("common", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "pos", "level"))).over(every)["level"])
    goal = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("common"), F.col("cap").cast("double")))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(goal / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long")
    out = ranked.withColumn("target", goal).withColumn("epochs", epochs)
    return out.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).select("src", "source_size", "weight", "target", "epochs", "rest")


def plan_sources(rows: DataFrame, weight_cycle: tuple[int, ...] = WEIGHT_CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: its target and where its fractional selection ends."""
    hist = stage(rows.groupBy("src", "bucket").agg(F.sum("size").alias("size")), "mixhist")
    goals = targets(hist.groupBy("src").agg(F.sum("size").alias("source_size")), weight_cycle, max_epochs)
    run = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = hist.withColumn("after", F.sum("size").over(run)).withColumn("before", F.col("after") - F.col("size"))
    steps = steps.withColumnRenamed("src", "step_src").join(goals, F.col("step_src").eqNullSafe(F.col("src")))
    inside = (F.col("before") < F.col("rest")) & (F.col("after") > F.col("rest"))
    ends = stage(
        steps.groupBy("src").agg(
            *[F.first(c).alias(c) for c in ("source_size", "weight", "target", "epochs", "rest")],
            F.coalesce(F.max(F.when(F.col("after") <= F.col("rest"), F.col("bucket"))), F.lit(-1)).alias("last_full"),
            F.coalesce(F.max(F.when(inside, F.col("bucket"))), F.lit(-1)).alias("edge"),
            F.coalesce(F.max(F.when(inside, F.col("before"))), F.lit(0)).alias("edge_before"),
        ),
        "mixends",
    )
    at_edge = ends.select(F.col("src").alias("edge_src"), "edge", "edge_before", "rest")
    edge = rows.join(at_edge, F.col("src").eqNullSafe(F.col("edge_src")) & (F.col("bucket") == F.col("edge")))
    order = Window.partitionBy("src").orderBy("key", "h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = edge.groupBy("src", "key", "h").agg(F.sum("size").alias("size"), F.first("edge_before").alias("edge_before"), F.first("rest").alias("rest"))
    ties = ties.withColumn("upto", F.sum("size").over(order) + F.col("edge_before"))
    chosen = ties.where(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"))
    cuts = chosen.groupBy(F.col("src").alias("cut_src")).agg(F.max(F.struct("key", "h")).alias("cut"))
    return stage(ends.join(cuts, F.col("src").eqNullSafe(F.col("cut_src")), "left").drop("cut_src"), "mixplan")


def _copies(key: Column, h: Column, bucket: Column) -> Column:
    below = (key < F.col("cut.key")) | ((key == F.col("cut.key")) & (h <= F.col("cut.h")))
    chosen = (bucket <= F.col("last_full")) | ((bucket == F.col("edge")) & F.coalesce(below, F.lit(False)))
    return F.col("epochs") + F.when(chosen & (F.col("rest") > 0), 1).otherwise(0)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """One row per document: id, size, source_size, target and taken (words, repeats counted)."""
    rows = stage(keyed(docs, doc_id, text, source), "mixkeys")
    plan = plan_sources(rows, **options).withColumnRenamed("src", "plan_src")
    joined = rows.join(plan, F.col("src").eqNullSafe(F.col("plan_src")))
    taken = F.col("size") * _copies(F.col("key"), F.col("h"), F.col("bucket"))
    return joined.select(F.col("id").alias(doc_id), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed documents themselves: each row as often as it is taken, with its own columns.

    Rows without words are neither needed nor in the way of a budget; they stay once.
    """
    rows = stage(keyed(docs, doc_id, text, source), "mixkeys")
    plan = plan_sources(rows, **options)
    own, facts = fresh(docs, "__mix_row"), fresh(docs, "__mix_facts")
    size = doc_size(F.col(text))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(own), F.struct(size.alias("size"), quality_weight(F.col(text), size).alias("w"), _row_hash(F.col(doc_id), F.col(text)).alias("h"), F.col(source).cast("string").alias("src")).alias(facts))
    flat = whole.select(own, f"{facts}.*")
    u = (F.conv(F.substring("h", 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))
    flat = flat.withColumn("key", -F.log(u) / F.col("w")).withColumn("bucket", bucket_of(F.col("key")))
    joined = flat.join(plan.withColumnRenamed("src", "plan_src"), F.col("src").eqNullSafe(F.col("plan_src")))
    times = F.when(F.col("size") == 0, 1).otherwise(_copies(F.col("key"), F.col("h"), F.col("bucket"))).cast("int")
    return joined.select(own, F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select(f"{own}.*")


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source AS src,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    coalesce(len(regexp_extract_all(text, '[#*$%&|<>!]')), 0) AS symbols,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS h
  FROM documents
), k AS (
  SELECT doc_id, src, size, h,
    -ln((CAST(CAST('0x' || substr(h, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
      / (1.0::DOUBLE / (1.0::DOUBLE + 4.0::DOUBLE * (CAST(symbols AS DOUBLE) / CAST(greatest(size, 1) AS DOUBLE)))) AS key
  FROM d
), s AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY src
), p AS (
  SELECT *, row_number() OVER (ORDER BY src NULLS LAST) AS pos FROM s
), w AS (
  SELECT *, (pos - 1) % 3 + 1 AS weight, 3 * source_size AS cap,
    CAST(3 * source_size AS DOUBLE) / CAST((pos - 1) % 3 + 1 AS DOUBLE) AS ratio FROM p
), v AS (
  SELECT *, CAST(sum(source_size) OVER () - sum(cap) OVER o + cap AS DOUBLE)
    / CAST(sum(weight) OVER () - sum(weight) OVER o + weight AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY ratio, pos ROWS UNBOUNDED PRECEDING)
), c AS (
  SELECT (SELECT level FROM v WHERE ratio > level ORDER BY ratio, pos LIMIT 1) AS common
), t AS (
  SELECT src, source_size, least(CAST(cap AS DOUBLE), coalesce(CAST(weight AS DOUBLE) * common, CAST(cap AS DOUBLE))) AS target FROM v, c
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS epochs FROM t
), r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.src ORDER BY k.key, k.h RANGE UNBOUNDED PRECEDING) AS upto,
    sum(k.size) OVER (PARTITION BY k.src, k.key, k.h) AS tied
  FROM k JOIN e ON k.src IS NOT DISTINCT FROM e.src
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (epochs + CASE WHEN rest > 0 AND 2 * upto - tied <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
