"""Cross-site boilerplate lines, found by HyperLogLog sketches of the sites they occur on.

Every line of at least ``MIN_WORDS`` words, trimmed, is hashed to 128 bits. One aggregation merges a
sketch of distinct sites per line hash. A line whose estimate is clearly above ``MIN_SITES`` is
boilerplate; lines within ``BAND`` of the threshold get an exact distinct count before they are
judged. A boilerplate line stays in the document with the smallest id that has it, so nothing is lost
altogether, and goes everywhere else.

Defined results: null text stays null and has no lines; an empty text is one empty line; a null site
is not counted as a site; where no document with the line has an id, it stays in all of them; rows
equal in id and text are treated alike; texts and lines of any length are read whole; an empty table gives
an empty result; input columns are kept, and the count of lines comes last (with underscores at its
name's end where that is taken).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.runtime import fresh, stage

MIN_WORDS = 3
MIN_SITES = 5
BAND = 0.5
LG_K = 10
BLANK = " \t\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def _row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def hashed_lines(docs: DataFrame, doc_id: str, text: str, site: str, min_words: int) -> DataFrame:
    """(id, row, site, pos, h1, h2) of every line with enough words."""
    rows = docs.select(F.col(doc_id).alias("id"), _row_key(F.col(doc_id), F.col(text)).alias("row"), F.col(site).cast("string").alias("site"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    rows = rows.where(F.regexp_count("line", F.lit(WORD)) >= min_words).withColumn("line", F.trim("line", F.lit(BLANK)))
    return rows.select("id", "row", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """(h1, h2, keeper): hashes of the lines on at least ``min_sites`` sites, and who keeps each."""
    key = ["h1", "h2"]
    sketched = lines.groupBy(*key).agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("id").alias("keeper"))
    judged = sketched.select(*key, "keeper", F.hll_sketch_estimate("sketch").alias("sites"))
    judged = stage(judged.where(F.col("sites") >= min_sites * (1 - band)), "lsjudged")
    near = judged.where(F.col("sites") <= min_sites * (1 + band))
    exact = lines.join(near.select(*key), key).groupBy(*key).agg(F.count_distinct("site").alias("n"))
    sure = judged.where(F.col("sites") > min_sites * (1 + band))
    settled = near.join(exact.where(F.col("n") >= min_sites), key, "left_semi")
    return stage(sure.unionAll(settled).select(*key, "keeper"), "lsboiler")


def remove_boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", removed: str = "n_removed", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and the number of lines taken out."""
    removed = fresh(docs, removed)
    lines = stage(hashed_lines(docs, doc_id, text, site, min_words), "lslines")
    found = lines.join(boilerplate(lines, min_sites), ["h1", "h2"]).where(F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper")))
    row, ident, gone = fresh(docs, "__row"), fresh(docs, "__id"), fresh(docs, "__gone")
    taken = found.groupBy(F.col("id").alias(ident), F.col("row").alias(row)).agg(F.collect_set("pos").alias(gone))
    taken = stage(taken, "lstaken")

    @F.pandas_udf("string")
    def without(texts: pd.Series, positions: pd.Series) -> pd.Series:
        out = []
        for value, places in zip(texts, positions, strict=True):
            if value is None or places is None:
                out.append(value)
                continue
            drop = set(places)
            out.append("\n".join(line for i, line in enumerate(value.split("\n")) if i not in drop))
        return pd.Series(out, dtype=object)

    # else a filter on the cleaned text would run it twice in one stage, each with its own Python worker a core
    without = without.asNondeterministic()
    same = F.col(f"left.{doc_id}").eqNullSafe(F.col(f"right.{ident}")) & (_row_key(F.col(f"left.{doc_id}"), F.col(f"left.{text}")) == F.col(f"right.{row}"))
    joined = docs.alias("left").join(taken.alias("right"), same, "left").drop(ident, row)
    # only texts that lose lines go through Python
    cleaned = without(F.when(F.col(gone).isNotNull(), F.col(text)), F.col(gone))
    out = joined.withColumn(removed, F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    out = out.withColumn(removed, F.when(F.col(gone).isNull(), 0).otherwise(F.col(removed)).cast("long"))
    return out.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(cleaned)).drop(gone)


def clean_documents(docs: DataFrame) -> DataFrame:
    """For pipelines: documents without cross-site boilerplate; those it was all of are left out."""
    n = fresh(docs, "__n_removed")
    out = remove_boilerplate(docs, removed=n)
    out = out.where((F.col(n) == 0) | (F.regexp_count("text", F.lit(WORD)) > 0)).drop(n)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out


def op6_line_spread(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    out = remove_boilerplate(docs)
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).alias("n_lines"), "n_removed", F.length("text").cast("long").alias("clean_chars"), F.md5(F.col("text").cast("binary")).alias("clean_md5"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, source, u.pos, u.line, trim(u.line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t,
    len(regexp_extract_all(u.line, '[^\x20\x09-\x0D]+')) >= 3 AS able
  FROM documents, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'pos': i, 'line': x})) AS x(u)
), b AS (
  SELECT t, min(doc_id) AS keeper FROM l WHERE able GROUP BY t HAVING count(DISTINCT source) >= 5
), k AS (
  SELECT l.*, (b.t IS NOT NULL AND l.able AND l.doc_id IS DISTINCT FROM b.keeper AND b.keeper IS NOT NULL) AS gone
  FROM l LEFT JOIN b ON l.t = b.t
), a AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS clean
  FROM k GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, length(clean) AS clean_chars, md5(clean) AS clean_md5 FROM a
"""
